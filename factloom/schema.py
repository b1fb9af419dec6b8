"""DDL of the fact tables."""

FILES = (
    "path string, module string, ext string, language string, size bigint, "
    "content string, error string"
)
PARAM = "struct<name:string,type:string,default:string>"
# One tagged row per extracted fact; the fact tables are projections of it.
FACT = (
    "path string, fact string, seq int, name string, kind string, line int, end_line int, "
    "signature string, return_type string, params array<" + PARAM + ">, docstring string, "
    "parent string, visibility string, is_static boolean, is_abstract boolean, "
    "module string, caller string"
)
SYMBOL_COLUMNS = [
    "path", "seq", "name", "kind", "line", "end_line", "signature", "return_type", "params",
    "docstring", "parent", "visibility", "is_static", "is_abstract",
]
