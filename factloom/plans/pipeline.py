"""The stages from a source folder to fact tables, outputs and reports.

Every stage writes its tables below ``out`` and the next one reads them, so a
stage can be run alone and a failed run goes on from the last written table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom import fixed_values as V
from factloom.operators import (
    callbacks as C, extract as X, facts as FA, markdown as M, modules as MO, outputs as O, stats, taxonomy, truth,
)
from factloom.operators.ordered import global_rank
from factloom.plans import reports as R
from factloom.functions import text as T
from factloom.session import stage_table, staging
from factloom.sources import artefacts as A, chat, files as S, versions


def phase_range(text: str) -> tuple[int, int]:
    """'all', 'a-b' or 'n' to (first, last)."""
    if text == "all":
        return 0, 4
    first, _, last = text.partition("-")
    return int(first), int(last or first)


def recon(spark: SparkSession, root: str, out: str) -> dict[str, DataFrame]:
    """Stage 0: statistics of all files, as small JSON tables."""
    listing = S.scan(spark, root).where(S.keep_for_stats(F.col("path")))
    known = S.with_language(S.with_text(S.scan(spark, root, list(V.STATS_LANGUAGE)).where(S.keep_for_stats(F.col("path")))), V.STATS_LANGUAGE)
    languages = stats.language_stats(known)
    tables = {
        "languages": languages, "totals": stats.totals(listing), "entry_points": stats.entry_points(listing),
        "top_level_dirs": stats.top_level_dirs(listing), "outline": stats.outline(listing),
        "primary_language": stats.primary_language(languages),
    }
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").json(f"{out}/metadata/{name}")
    return tables


def structure(
    spark: SparkSession, root: str, out: str, max_files: int | None = None, skip_tests: bool = False
) -> dict[str, DataFrame]:
    """Stage 1: facts of every file. Each file is parsed once."""
    functions = taxonomy.function_table(spark)
    source = S.source_files(spark, root, max_files, skip_tests)
    # the contents are read and written once, without a shuffle; only paths are ranked
    t = {"files": A.write_table(source, out, "files")}
    good = t["files"].where("error = ''")
    tagged = A.write_table(X.extract(good), out, "facts", "fact")
    t["symbols"] = A.write_table(X.symbols(tagged).unionByName(X.sql_symbols(good)), out, "symbols")
    t["imports"] = A.write_table(X.imports(tagged), out, "imports")
    t["sql_stmts"] = A.write_table(FA.embedded_sql(good.where("language <> 'SQL'")).drop("seq"), out, "sql_stmts")
    jvm = good.where(F.col("language").isin("Scala", "Java"))
    t["udfs"] = A.write_table(FA.udf_registrations(jvm), out, "udfs")
    t["xml_loaders"] = A.write_table(FA.xml_loaders(jvm), out, "xml_loaders")
    c_only = good.where("language = 'C'")
    t["func_ptrs"] = A.write_table(C.pointer_fields(c_only), out, "func_ptrs")
    t["callback_regs"] = A.write_table(C.registrations(c_only), out, "callback_regs")
    t["indirect_calls"] = A.write_table(C.indirect_calls(c_only), out, "indirect_calls")
    t["dispatch_tables"] = A.write_table(C.dispatch_tables(t["func_ptrs"], t["callback_regs"]), out, "dispatch_tables")
    t["dispatch_callbacks"] = A.write_table(C.dispatch_callbacks(t["func_ptrs"], t["callback_regs"]), out, "dispatch_callbacks")
    t["java_dispatch"] = A.write_table(C.java_dispatch(t["symbols"].join(good.where("language = 'Java'").select("path"), "path", "left_semi")), out, "java_dispatch")
    edges = C.indirect_edges(t["indirect_calls"], t["callback_regs"])
    t["calls"] = A.write_table(X.call_graph(X.direct_calls(tagged), X.xml_sql_calls(tagged, functions), edges), out, "calls")
    t["xml_tables"] = A.write_table(FA.table_refs(X.xml_sql(tagged), ["path"], qualified=False), out, "xml_tables")
    t["errors"] = A.write_table(
        X.errors(tagged).unionByName(t["files"].where("error <> ''").select("path", "error")), out, "errors"
    )
    ordered = global_rank(t["files"].select("path", "module", "language"), ["path"], "file_seq")
    t["module_files"] = A.write_table(MO.split_modules(ordered, "file_seq"), out, "module_files")
    A.write_modules(A.nested_files(t["files"], t["symbols"], t["imports"], X.direct_calls(tagged), t["sql_stmts"]), out)
    return t


def summary(t: DataFrame | dict) -> DataFrame:
    """Row counts of the stage-1 tables: fact, n."""
    parts = [
        t[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("fact"), "n")
        for name in ("files", "symbols", "imports", "calls", "errors")
    ]
    modules = t["files"].agg(F.countDistinct("module").alias("n")).select(F.lit("modules").alias("fact"), "n")
    total = parts[0]
    for part in [*parts[1:], modules]:
        total = total.unionByName(part)
    return total


def identify_outputs(spark: SparkSession, root: str, out: str, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stage 1.5: output points in three layers, and what feeds them."""
    keep = S.keep_for_outputs(F.col("path"))
    scanned = S.with_text(S.scan(spark, root, V.OUTPUT_EXTENSIONS).where(keep))
    # the same patterns: only files the first layer has not read can add a row
    others = t["files"].where("error = ''").where(~(T.extension(F.col("path")).isin(*V.OUTPUT_EXTENSIONS) & S.keep_for_outputs(F.col("path"))))
    layers = [O.regex_outputs(scanned), O.regex_outputs(others, confidence="medium", layer="ast"), O.sql_outputs(t["sql_stmts"])]
    found = O.merge_layers(layers)
    headers = S.scan(spark, root, V.PUBLIC_HEADER_EXTENSIONS).unionByName(S.scan(spark, root).where(F.col("path").isin(*V.LIBRARY_BUILD_FILES)))
    library = O.library_outputs(S.with_text(headers))
    t["outputs"] = A.write_table(O.with_library_fallback(found, library), out, "outputs")
    t["output_inputs"] = A.write_table(O.trace_inputs(t["outputs"], t["calls"], t["sql_stmts"], t["symbols"]), out, "output_inputs")
    return t


def analyse_modules(
    out: str, t: dict[str, DataFrame], make_client: Callable, cached: DataFrame | None = None, force: bool = False,
    context_size: int = 4000, resume: bool = False, min_chars: int = 0,
) -> DataFrame:
    """Stage 2: a text per module, or part of a large one, from the injected generator.

    ``cached`` texts of more than ``min_chars`` characters are taken as they are;
    ``resume`` takes those stored below ``out`` likewise. Only modules without one
    reach the generator. The result is a new version of the stored table.
    """
    spark = t["files"].sparkSession
    stored = A.read_table(spark, out, "analyses") if resume and not force and versions.current(spark, out, "analyses") else None
    have = cached if cached is not None and not force else stored
    have = have.where(F.length("markdown") > min_chars).select("module", "markdown") if have is not None else None
    parts = t["module_files"].select("path", F.col("part").alias("module"), "file_seq")
    placed = t["files"].drop("module").join(parts, "path")
    index = MO.symbol_index(t["symbols"], placed)
    preview = MO.source_preview(placed, t["symbols"], "file_seq", context_size)
    info = R.callback_info(placed, t["dispatch_tables"], t["func_ptrs"], t["dispatch_callbacks"], t["callback_regs"], t["indirect_calls"])
    prompts = R.module_prompts(placed, "file_seq", index, preview, info, MO.module_outputs(placed, t["outputs"]))
    if have is not None:
        prompts = prompts.join(have.select("module"), "module", "left_anti")
    with_symbols = placed.join(t["symbols"].select("path").distinct(), "path", "left_semi").select("module").distinct()
    prompts = prompts.join(with_symbols, "module", "left_semi")
    fresh = A.write_table(chat.generate(prompts, make_client), out, "generated")
    fixed = M.wrap_diagrams(M.fix_diagrams(fresh.where("error = ''"), ["module"], "markdown", "markdown"), ["module"], "markdown", "markdown")
    every = fixed.select("module", "markdown")
    return A.write_table(every if have is None else every.unionByName(have), out, "analyses")


def validate(texts: DataFrame, keys: list[str], t: dict[str, DataFrame], out: str, name: str = "validated") -> DataFrame:
    """Mentions of each text with their status, exact first, then by likeness."""
    index = A.write_table(truth.truth_index(t["calls"], t["symbols"], t["udfs"]), out, "truth_index")
    found = A.write_table(truth.mentions(texts, keys), out, f"{name}_mentions")
    exact = A.write_table(truth.validate_calls(found, index), out, f"{name}_exact")
    return A.write_table(truth.rescue(exact, truth.known_names(t["calls"], t["symbols"])), out, name)


def generate_and_refine(
    prompts: DataFrame, t: dict[str, DataFrame], make_client: Callable, out: str,
    threshold: float = V.REFINE_THRESHOLD, rounds: int = V.MAX_REFINEMENTS,
) -> DataFrame:
    """Stages 2.5 and 3: generate, validate, and correct texts below the threshold.

    Gives (module, text, accuracy); prompts are (module, system, user).
    """
    system = prompts.select("module", "system")
    texts = A.write_table(chat.generate(prompts, make_client), out, "round_0")
    for n in range(rounds + 1):
        fixed = M.fix_diagrams(texts.withColumnRenamed("markdown", "text"), ["module"], "text", "text").select("module", "text")
        fixed = A.write_table(M.wrap_diagrams(fixed, ["module"], "text", "text"), out, f"texts_{n}")
        checked = validate(fixed, ["module"], t, out, f"validated_{n}")
        scored = A.write_table(truth.accuracy(checked, ["module"], fixed), out, f"accuracy_{n}")
        if n == rounds:
            break
        poor = scored.where((F.col("accuracy") < threshold) & (F.col("unverified") > 0)).select("module")
        again = R.correction_prompts(fixed.join(poor, "module", "left_semi"), checked, ["module"]).join(system, "module")
        redone = A.write_table(chat.generate(again.withColumnRenamed("prompt", "user"), make_client), out, f"redone_{n}")
        good = fixed.join(redone.where("error = ''").select("module"), "module", "left_anti").withColumnRenamed("text", "markdown")
        texts = good.unionByName(redone.where("error = ''").select("module", "markdown"))
    notes = R.validation_summary(checked, ["module"])
    whole = fixed.join(notes, "module", "left").join(scored.select("module", "accuracy"), "module")
    text = F.when(F.col("summary").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n\n---\n\n"), "summary"))
    return whole.select("module", text.alias("text"), "accuracy")


def report(spark: SparkSession, out: str, t: dict[str, DataFrame], analyses: DataFrame, title: str, metadata: dict[str, DataFrame],
           architecture: str | DataFrame = "", flows: str | DataFrame = "") -> None:
    """Stage 4: the final document and the output report as text and HTML, one text and page per module."""
    guide = R.rebuild_guide(metadata["totals"], metadata["primary_language"])
    outputs = R.io_flow_document(t["outputs"], t["output_inputs"], title, analyses)
    for name, lines in (("report", R.final_document(analyses, title, architecture, flows, guide)), ("io_flows", outputs)):
        lines = stage_table(lines)
        R.write_document(lines, f"{out}/{name}")
        R.write_document(R.html_document(lines, title), f"{out}/{name}_html")
    pages = R.html_pages(analyses, ["module"], "markdown", F.col("module"))
    pages.write.mode("overwrite").parquet(f"{out}/module_pages")
    single = M.normalize_headings(analyses, ["module"], "markdown", 1, "markdown")
    single.write.mode("overwrite").parquet(f"{out}/module_texts")


# tables of stages 1 and 1.5, as a later stage reads them back
STORED = (
    "files", "symbols", "imports", "sql_stmts", "udfs", "xml_loaders", "func_ptrs", "callback_regs", "indirect_calls", "dispatch_tables", "dispatch_callbacks", "java_dispatch", "calls",
    "xml_tables", "errors", "module_files", "outputs", "output_inputs",
)


def texts_over_modules(out: str, t: dict[str, DataFrame], analyses: DataFrame, make_client: Callable, resume: bool = False) -> dict[str, DataFrame]:
    """Stages 2.5 and 3: flows across modules, and the architecture, validated and refined.

    With ``resume`` a stored text is kept where its prompt is still the same.
    """
    spark = analyses.sparkSession
    lines = R.all_callbacks(t["dispatch_tables"], t["dispatch_callbacks"], t["callback_regs"], t["indirect_calls"])
    prompts = {
        "cross_flows": R.flow_prompts(t["calls"], lines, analyses),
        "synthesis": R.synthesis_prompts(R.structured_context(t["files"], t["symbols"], t["calls"], t["imports"], t["udfs"], t["xml_loaders"]), analyses),
    }
    found = {}
    for name, prompt in prompts.items():
        asked = stage_table(prompt.withColumn("asked", F.sha2(F.to_json(F.struct("system", "user")), 256)))
        have = None
        if resume and versions.current(spark, out, name):
            have = A.read_table(spark, out, name).join(asked.select("module", "asked"), ["module", "asked"], "left_semi")
            asked = asked.join(have.select("module"), "module", "left_anti")
            if asked.isEmpty():
                found[name] = A.write_table(have, out, name)
                continue
        done = generate_and_refine(asked.drop("asked"), t, make_client, f"{out}/{name}_rounds").join(asked.select("module", "asked"), "module")
        found[name] = A.write_table(done if have is None else done.unionByName(have), out, name)
    return found


def run(
    spark: SparkSession, root: str, out: str, phases: str = "all", max_files: int | None = None, skip_tests: bool = False,
    make_client: Callable | None = None, context_size: int = 4000, force: bool = False, title: str = "Report",
) -> dict[str, DataFrame]:
    """Runs the stages of ``phases``; stages 2 and 3 need a generator.

    A range that starts later reads what earlier stages have stored. Texts stored
    by an earlier run are kept, module by module, unless ``force``. What the
    stages stage in the shared folder is gone at the end.
    """
    first, last = phase_range(phases)
    t: dict[str, DataFrame] = {}
    with staging(spark):
        metadata = recon(spark, root, out) if first <= 0 else {}
        if last >= 1 and first <= 1:
            t = identify_outputs(spark, root, out, structure(spark, root, out, max_files, skip_tests))
        elif last >= 1:
            t = {name: A.read_table(spark, out, name) for name in STORED}
        if last >= 2 and first > 2:
            t["analyses"] = A.read_table(spark, out, "analyses")
        elif last >= 2 and make_client:
            t["analyses"] = analyse_modules(out, t, make_client, force=force, context_size=context_size, resume=not force)
        if last >= 3 and first > 3:
            t |= {name: A.read_table(spark, out, name) for name in ("cross_flows", "synthesis")}
        elif last >= 3 and make_client and "analyses" in t:
            t |= texts_over_modules(out, t, t["analyses"], make_client, resume=not force)
        if last >= 4 and "analyses" in t:
            metadata = metadata or recon(spark, root, out)
            text = lambda name: R.part_texts(t[name]) if name in t else ""
            report(spark, out, t, t["analyses"], title, metadata, text("synthesis"), text("cross_flows"))
    return {**metadata, **t}
