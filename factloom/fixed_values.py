"""Results are only right if these equal the agreed ones.

Word lists, lookup tables, patterns and limits are data, not logic. Each is
stated plainly and in one place; the operators take them as default arguments.
"""

# Language by file extension, repository statistics.
STATS_LANGUAGE = {
    ".c": "C", ".h": "C",
    ".cc": "C++", ".cpp": "C++", ".cxx": "C++", ".hpp": "C++", ".hxx": "C++",
    ".java": "Java", ".scala": "Scala", ".sc": "Scala", ".py": "Python", ".sql": "SQL",
    ".js": "JavaScript", ".ts": "TypeScript", ".go": "Go", ".rs": "Rust", ".rb": "Ruby",
    ".xml": "XML", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON",
    ".proto": "Protobuf", ".thrift": "Thrift",
}

# Language by file extension, fact extraction.
EXTRACT_LANGUAGE = {
    ".c": "C", ".h": "C",
    ".cc": "C++", ".cpp": "C++", ".cxx": "C++", ".hpp": "C++", ".hxx": "C++",
    ".java": "Java", ".scala": "Scala", ".sc": "Scala", ".py": "Python", ".sql": "SQL",
    ".xml": "XML", ".xsd": "XML", ".xsl": "XML", ".xslt": "XML",
}

# Extensions scanned for output points.
OUTPUT_EXTENSIONS = [
    ".py", ".scala", ".java", ".sql", ".xml", ".js", ".ts", ".go", ".rs", ".rb",
    ".c", ".cpp", ".h",
]

# Path segments left out of each scan.
SKIP_STATS = [
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".tox", ".venv", "venv", "env",
    ".env", "dist", "build", "target", ".idea", ".vscode", ".gradle", ".m2", "vendor",
    "third_party", "external", "deps", ".cache", "egg-info", ".eggs",
]
SKIP_EXTRACT = [
    ".git", ".svn", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target",
    ".gradle", ".idea", ".vscode", "vendor", "third_party", "external", "deps", ".cache",
]
SKIP_OUTPUT = [
    ".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target",
    ".gradle", ".idea", ".vscode",
]
DOT_NAMES_KEPT = [".github"]

# Build system by marker file.
BUILD_SYSTEMS = {
    "CMakeLists.txt": "CMake", "Makefile": "Make", "makefile": "Make",
    "build.gradle": "Gradle", "build.gradle.kts": "Gradle (Kotlin DSL)",
    "pom.xml": "Maven", "build.sbt": "sbt", "build.sc": "Mill", "setup.py": "setuptools",
    "pyproject.toml": "pyproject", "requirements.txt": "pip", "Cargo.toml": "Cargo",
    "go.mod": "Go modules", "package.json": "npm", "meson.build": "Meson",
    "WORKSPACE": "Bazel", "BUILD": "Bazel",
}

# Entry points.
ENTRY_NAMES = [
    "main.py", "app.py", "manage.py", "__main__.py", "Main.java", "main.c", "main.cpp",
]
ENTRY_EXTENSIONS = [".py", ".java", ".c", ".cpp", ".scala"]

# Test files.
TEST_DIRS = [
    "test", "tests", "testing", "__tests__", "spec", "specs", "test_fixtures", "testdata",
    "test_data", "test-resources",
]
TEST_FILE_PATTERNS = [
    r"^test_\w+\.py$", r"^\w+_test\.py$", r"^tests?\.py$",
    r"^\w+Test\.java$", r"^\w+Tests\.java$",
    r"^\w+Spec\.scala$", r"^\w+Test\.scala$", r"^\w+Suite\.scala$",
    r"^\w+\.test\.(js|ts|jsx|tsx)$", r"^\w+\.spec\.(js|ts|jsx|tsx)$", r"^\w+[-_]test\.(js|ts)$",
    r"^\w+_test\.go$", r"^test_\w+\.rs$",
    r"^\w+_test\.(c|cpp|cc|cxx)$", r"^\w+_tests\.(c|cpp|cc|cxx)$", r"^test_\w+\.(c|cpp|cc|cxx)$",
    r"^\w+_spec\.rb$", r"^\w+_test\.rb$", r"^\w+Test\.php$",
]
TEST_MARKER_WINDOW = 5000
# The same folder names also stand with a parent (src/test, src/tests); a folder
# name alone already decides, so those two have no effect.
TEST_MARKERS = {
    "python": [
        "import unittest", "import pytest", "from unittest", "from pytest", "@pytest.fixture",
        "@pytest.mark", "def test_", "class Test",
    ],
    "java": [
        "@Test", "@BeforeEach", "@AfterEach", "@BeforeAll", "@AfterAll", "import org.junit",
        "import org.testng", "import static org.junit",
    ],
    "scala": ["import org.scalatest", "import org.specs2", "class.*Spec.*extends", "class.*Suite.*extends"],
    "javascript": ["describe(", "it(", "test(", "expect(", "import.*from.*jest", "import.*from.*vitest"],
    "go": ['import.*testing"', "func Test"],
    "rust": ["#[test]", "#[cfg(test)]"],
    "ruby": ["require.*rspec", "describe.*do", "RSpec.describe"],
}
# own choice: the extensions each language's markers are meant for
TEST_MARKER_EXTENSIONS = {
    "python": [".py"], "java": [".java"], "scala": [".scala", ".sc"], "javascript": [".js", ".ts", ".jsx", ".tsx"],
    "go": [".go"], "rust": [".rs"], "ruby": [".rb"],
}

# Limits of the stored views; nothing is cut unless a caller passes one.
MAX_FILE_BYTES = 2_000_000
MAX_FILES = 5_000
MAX_GRAPH_ROWS = 5_000
MAX_CALLBACK_ROWS = 500

# Words that look like SQL function calls but are keywords.
SQL_KEYWORDS = [
    "select", "from", "where", "group", "by", "order", "having", "join", "left", "right",
    "inner", "outer", "full", "cross", "on", "and", "or", "not", "in", "between", "like", "is",
    "null", "true", "false", "case", "when", "then", "else", "end", "insert", "into", "values",
    "update", "set", "delete", "create", "alter", "drop", "table", "view", "index", "as",
    "distinct", "all", "union", "intersect", "except", "limit", "offset", "asc", "desc", "nulls",
    "first", "last", "with", "recursive", "lateral", "unnest", "window", "over", "partition",
    "rows", "range", "unbounded", "preceding", "following", "current", "row", "merge", "using",
    "matched", "cache", "uncache", "explain", "describe", "show", "use", "add", "file", "jar",
    "refresh", "reset", "msck", "repair", "load", "data", "overwrite", "local", "inpath",
    "stored", "format", "location", "partitioned", "clustered", "sorted", "buckets", "serde",
    "properties", "temporary", "temp", "function", "macro",
]

# Words that are never table names, per use.
TABLE_STOP_TRUTH = ["select", "where", "and", "or", "null", "set", "as", "on", "from"]
TABLE_STOP_STATEMENT = ["set", "select", "where", "and", "or", "null"]
TABLE_STOP_INPUT = ["select", "where", "and", "or", "null"]

# SQL verbs.
SQL_VERBS = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP"]
SQL_VERBS_XML = SQL_VERBS + ["WITH"]

# SQL patterns.
SQL_CALL = r"\b([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)?)\s*\("
TABLE_QUALIFIED = r"""(?i)\b(?:FROM|JOIN|INTO|OVERWRITE\s+TABLE|TABLE)\s+([`"']?\w+(?:\.\w+)*[`"']?)"""
TABLE_FIRST_WORD = r"""(?i)\b(?:FROM|JOIN|INTO|OVERWRITE\s+TABLE|TABLE)\s+[`"']?(\w+)"""
TABLE_MENTION = r"""(?i)\b(?:FROM|JOIN|INTO|TABLE)\s+[`"']?(\w+)"""
CTE_NAME = r"(?i)\bWITH\s+(?:RECURSIVE\s+)?(\w+)\s+AS\s*\("
INPUT_TABLE = r"""(?i)FROM\s+[`"']?(\w+(?:\.\w+)*)[`"']?"""
EMBEDDED_SQL = r"""(?is)["'](\s*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\s+.+?)["']"""
INSERT_TARGET = r"""(?i)INSERT\s+(OVERWRITE\s+)?(?:INTO\s+)?TABLE?\s+[`"']?(\w+(?:\.\w+)*)[`"']?"""
CREATE_TARGET = r"""(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:EXTERNAL\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`"']?(\w+(?:\.\w+)*)[`"']?"""

# C function pointer patterns.
C_POINTER_FIELD = r"(\w[\w\s\*]*?)\s*\(\s*\*\s*(\w+)\s*\)\s*\(([^)]*)\)\s*;"
C_ASSIGNMENT = r"(\w+(?:->|\.)\w+)\s*=\s*(&?\s*\w+)\s*;"
C_POINTER_CALL = r"(?:\(\s*\*\s*)?(\w+(?:->|\.)+[\w>]+)(?:\s*\)?)\s*\("
C_TYPEDEF_STRUCT = r"typedef\s+struct\s*(?:\w+)?\s*\{([^}]+)\}\s*(\w+)\s*;"
C_STRUCT = r"struct\s+(\w+)\s*\{([^}]+)\}"
POINTER_FIELD_NAMES = [
    "handler", "callback", "init", "exit", "create", "destroy", "read", "write", "connect",
    "accept", "close", "process", "preconfiguration", "postconfiguration", "init_main_conf",
    "init_server_conf", "init_location_conf", "merge", "content_handler", "filter", "checker",
    "resolver", "alloc", "free", "copy", "compare", "hash", "send", "recv", "input_filter",
    "output_filter",
]
POINTER_FIELD_SUFFIXES = ["_handler", "_cb", "_func"]

# UDF registrations in Scala/Java, in priority order.
UDF_PATTERNS = [
    r"""spark\.udf\.register\s*\(\s*["'](\w+)["']""",
    r"""spark\.udf\.register\s*\(\s*["'](\w+)["']\s*,\s*(\w+)""",
    r"""\.udf\.register\s*\(\s*["'](\w+)["']""",
    r"""UDF\s*\(\s*["'](\w+)["']""",
    r"""registerFunction\s*\(\s*["'](\w+)["']""",
    r"""registerJavaFunction\s*\(\s*["'](\w+)["']\s*,\s*["']([^"']+)["']""",
    r"""@(?:udf|UDF)\s*(?:\([^)]*\))?\s*(?:class|object)\s+(\w+)""",
    r"""UDFRegistration\s*\(\s*["'](\w+)["']""",
    r"""\.register\s*\(\s*["'](\w+)["']\s*,""",
]
# Label of a UDF registration by text it contains, in priority order.
UDF_LABELS = [
    ("spark.udf.register", "spark.udf.register"),
    ("registerJavaFunction", "registerJavaFunction"),
    ("registerFunction", "registerFunction"),
    ("@udf", "@UDF annotation"),
]
UDF_LABEL_OTHER = "udf.register"
ENCLOSING_CLASS = r"(?:class|object)\s+(\w+)"
ENCLOSING_CLASS_WINDOW = 2000

# XML loads in Scala/Java, in priority order.
XML_LOAD_PATTERNS = [
    r"""\.read\.xml\s*\(\s*["']([^"']+\.xml)["']""",
    r"""\.format\s*\(\s*["']xml["']\s*\)\s*(?:\.option\([^)]*\)\s*)*\.load\s*\(\s*["']([^"']+)["']""",
    r"""XMLLoader\.load\s*\(\s*["']([^"']+\.xml)["']""",
    r"""XmlReader\s*\(\s*["']([^"']+\.xml)["']""",
    r"""\.load\s*\(\s*["']([^"']+\.xml)["']""",
    r"""Source\s*\.\s*fromFile\s*\(\s*["']([^"']+\.xml)["']""",
    r"""XML\.(?:parse|load)\s*\(\s*["']([^"']+\.xml)["']""",
    r"""(?:configFile|configPath|xmlFile|xmlPath)\s*=\s*["']([^"']+\.xml)["']""",
]
# Label of an XML load by text it contains, in priority order.
XML_LOAD_LABELS = [
    (".read.xml", "spark.read.xml"),
    (".format", "spark.read.format(xml)"),
    ("XMLLoader", "XMLLoader.load"),
    ("XmlReader", "XmlReader"),
    ("XML.parse", "scala.xml.XML"),
    ("XML.load", "scala.xml.XML"),
    ("Source.fromFile", "scala.io.Source"),
]
XML_LOAD_LABEL_OTHER = ".load(xml)"

# Output point patterns in priority order:
# (pattern, output type, naming rule, label). A naming rule is a group number
# or the kind of text the first fitting group must look like.
OUTPUT_PATTERNS = [
    (r"""INSERT\s+(?:OVERWRITE\s+)?(?:INTO\s+)?TABLE?\s+[`"']?(\w+(?:\.\w+)*)[`"']?""",
     "db_table", "table", "SQL INSERT"),
    (r"""CREATE\s+(?:OR\s+REPLACE\s+)?(?:EXTERNAL\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`"']?(\w+(?:\.\w+)*)[`"']?""",
     "db_table", "table", "SQL CREATE TABLE"),
    (r"""MERGE\s+INTO\s+[`"']?(\w+(?:\.\w+)*)[`"']?""", "db_table", "table", "SQL MERGE"),
    (r"""\.write\.(parquet|csv|json|orc|text|avro|delta)\s*\(\s*["']([^"']+)["']""",
     "spark_file", 2, "Spark write.format"),
    (r"""\.save\s*\(\s*["']([^"']+)["']""", "spark_file", 1, "Spark .save()"),
    (r"""\.saveAsTable\s*\(\s*["']([^"']+)["']""", "spark_table", 1, "Spark saveAsTable"),
    (r"""\.insertInto\s*\(\s*["']([^"']+)["']""", "spark_table", 1, "Spark insertInto"),
    (r"""spark\.sql\s*\(\s*["'].*?INSERT\s+(?:OVERWRITE\s+)?(?:INTO\s+)?TABLE?\s+[`"']?(\w+)""",
     "spark_table", 1, "Spark SQL INSERT"),
    (r"""\.option\s*\(\s*["']dbtable["']\s*,\s*["']([^"']+)["']""",
     "db_table", 1, "Spark JDBC dbtable"),
    (r"""open\s*\(\s*["']([^"']+)["']\s*,\s*["']w""", "file", "path", "Python open(w)"),
    (r"""\.(to_csv|to_json|to_parquet|to_orc|to_excel)\s*\(\s*["']([^"']+)["']""",
     "file", 2, "Pandas to_*()"),
    (r"""json\.dump\s*\([^,]+,\s*open\s*\(\s*["']([^"']+)["']""", "file", 1, "json.dump"),
    (r"""Path\s*\(\s*["']([^"']+)["']\s*\)\s*\.\s*write_""", "file", 1, "Path.write_*"),
    (r"""@\w+\.route\s*\(\s*["']([^"']+)["']""", "api_endpoint", "url", "Flask route"),
    (r"""@\w+\.(get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']""",
     "api_endpoint", 2, "FastAPI route"),
    (r"""path\s*\(\s*["']([^"']+)["']""", "api_endpoint", 1, "Django path"),
    (r"""@(Get|Post|Put|Delete|Request)Mapping\s*\(\s*(?:value\s*=\s*)?["']([^"']+)["']""",
     "api_endpoint", 2, "Spring Mapping"),
    (r"""\.send\s*\(\s*["']([^"']+)["']""", "message", 1, "Kafka/RabbitMQ send"),
    (r"""\.publish\s*\(\s*["']([^"']+)["']""", "message", 1, "publish()"),
    (r"""\.emit\s*\(\s*["']([^"']+)["']""", "message", 1, "emit()"),
]
# Text every match of an output pattern contains, in lower case, in the same order.
OUTPUT_NEEDS = [
    "insert", "create", "merge", ".write.", ".save", ".saveastable", ".insertinto", "spark.sql", "dbtable", "open",
    ".to_", "json.dump", "path", ".route", "@", "path", "mapping", ".send", ".publish", ".emit",
]
# The shape a group must have under each naming rule, and the
# name used if none fits.
NAME_SHAPES = {
    "table": (r"^[a-zA-Z_]\w*(\.\w+)*$", "unknown_table"),
    "path": (r"[/.]", "unknown_file"),
    "url": (r"^/", "unknown_endpoint"),
}
CONFIDENCE_ORDER = ["high", "medium", "low"]
CONFIDENCE_ICONS = {"high": "🟢", "medium": "🟡", "low": "🔴"}
CONFIDENCE_ICON_OTHER = "⚪"
READ_WORDS = ["read", "load", "source", "input"]

# Library outputs.
PUBLIC_HEADER_DIRS = ["include", "inc", "api", "public", "headers", "interface"]
PUBLIC_HEADER_EXTENSIONS = [".h", ".hpp", ".hxx"]
LIBRARY_BUILD_FILES = [
    "CMakeLists.txt", "Makefile", "build.gradle", "Cargo.toml", "setup.py", "pyproject.toml",
]
LIBRARY_MARKERS = ["add_library", "LIBRARY", "crate-type", "library"]
LIBRARY_MARKER_WINDOW = 5000

# Names mentioned in generated text.
MENTION_PATTERNS = [
    r"->>+[^:]+:\s*(\w+(?:\.\w+)?)",
    r"""\["?(?:调用|call)?\s*(\w+(?:\.\w+)?)["?\]]""",
    r"\b([a-zA-Z_]\w+(?:\.\w+)*)\s*\(",
]
UDF_MENTION = r"\b(?:udf|UDF)[_]?(\w+)"
FUZZY_THRESHOLD = 0.7
REFINE_THRESHOLD = 0.70
MAX_REFINEMENTS = 1

# Headings of sections that come first in a summary.
PRIORITY_HEADINGS = [
    "模块职责", "公共接口", "核心业务流程", "核心算法", "数据结构",
    "module responsibility", "public interface", "core flow", "core algorithm",
]

# Words of headings whose lines go into the output report.
KEY_HEADING_WORDS = ["职责", "接口", "流程", "算法", "responsibilit", "interface", "flow", "algorithm"]

# Diagram line repairs as (pattern, replacement).
FLOWCHART_REPAIRS = [
    (r'(\w+)\[([^"\]]*?)\(([^)]*?)\)([^"\]]*?)\]', '$1["$2$3$4"]'),
    (r'(\w+)\{([^"}]*?)\(([^)]*?)\)([^"}]*?)\}', '$1{"$2$3$4"}'),
    (r"\|([^|]*?)\(([^)]*?)\)([^|]*?)\|", "|$1$2$3|"),
    (r'-- "?([^"]*?)\(([^)]*?)\)([^"]*?)"?\s*-->', '-- "$1$2$3" -->'),
    (r'(\w+)\{\s*([^"}]*?)\s*=\s*"([^"]*)"\}', '$1{"$2 is $3"}'),
    (r'(\w+)\{\s*([^"}]*?)\s*=\s*(true|false|null|nil)\}', '$1{"$2 is $3"}'),
    (r'(\w+)\["\s*([^"]*?)\s*=\s*([^"]*?)\s*"\]', '$1["set $2 to $3"]'),
    (r'(\w+)\["end"\]', '$1["End"]'),
    (r'(\w+)\("end"\)', '$1("End")'),
    (r"(---+)([ox][a-z])", "$1 $2"),
]
SEQUENCE_QUOTES = (r'(->>|-->>)\s*(.*)\s*=\s*"([^"]*)"', "$1 $2=$3")
SEQUENCE_BLOCKS = ["alt", "opt", "loop", "break", "par", "critical", "rect"]

# Build guide by build system, in priority order: (text the
# lower-cased build system name contains, guide).
BUILD_GUIDES = [
    ("cmake", "cmake"), ("make", "make"), ("gradle", "gradle"), ("maven", "maven"),
    ("cargo", "cargo"), ("npm", "npm"), ("package.json", "npm"), ("go mod", "go"),
    ("go.mod", "go"), ("pyproject", "python"), ("setup.py", "python"), ("setuptools", "python"),
    ("pip", "python"),
]
