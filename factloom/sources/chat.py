"""Text generation as a table: prompts in, Markdown out.

The generator is a callable the caller injects; nothing here opens a
connection. Response bodies are read with Spark's JSON functions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_DELTA = "struct<choices:array<struct<delta:struct<content:string>>>>"


def is_event_stream(body: Column) -> Column:
    return F.ltrim(body).startswith("data:")


def response_content(df: DataFrame, keys: Sequence[str], body: str, out: str = "content") -> DataFrame:
    """Message text of each response body, plain JSON or event stream.

    Stream chunks are joined in order; without chunks the last JSON line
    counts. An empty content falls back to the reasoning text.
    """
    bare = F.transform(F.split(F.col(body), r"\r?\n|\r"), lambda l: F.trim(l))
    data = F.transform(F.filter(bare, lambda l: l.startswith("data:")), lambda l: F.trim(F.substring(l, 6, 1 << 30)))
    valid = F.filter(data, lambda p: (p != "[DONE]") & F.get_json_object(p, "$").isNotNull() & p.startswith("{"))
    chunks = F.array_join(
        F.transform(valid, lambda p: F.coalesce(F.get_json_object(p, "$.choices[0].delta.content"), F.lit(""))), ""
    )
    last = F.try_element_at(valid, F.lit(-1))
    json = F.when(is_event_stream(F.col(body)), last).otherwise(F.col(body))
    message = lambda field: F.coalesce(F.get_json_object(json, f"$.choices[0].message.{field}"), F.lit(""))
    whole = F.when(message("content") != "", message("content")).otherwise(message("reasoning_content"))
    text = F.when(is_event_stream(F.col(body)) & (chunks != ""), chunks).otherwise(whole)
    return df.select(*keys, text.alias(out))


def generate(
    prompts: DataFrame, make_client: Callable[[], Callable[[str, str], str]], retries: int = 3, wait: float = 1.0
) -> DataFrame:
    """Runs a text generator over prompts (module, system, user).

    ``make_client`` is called once per task and gives a function from (system,
    user) to text. Timeouts and lost connections are retried with a doubling
    wait; a prompt that keeps failing becomes a row with an error. Write the
    result to a table before using it twice: every action calls the generator.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        client = make_client()
        for batch in batches:
            rows = []
            for module, system, user in zip(*(c.to_pylist() for c in batch.columns)):
                text, error = "", ""
                for attempt in range(retries):
                    try:
                        text, error = client(system, user), ""
                        break
                    except (TimeoutError, ConnectionError) as failure:
                        error = f"{type(failure).__name__}: {failure}"
                        if attempt < retries - 1:
                            time.sleep(wait * 2 ** attempt)
                    except Exception as failure:
                        error = f"{type(failure).__name__}: {failure}"
                        break
                rows.append({"module": module, "markdown": text, "error": error})
            yield pa.RecordBatch.from_pylist(
                rows, pa.schema([("module", pa.string()), ("markdown", pa.string()), ("error", pa.string())])
            )

    return prompts.select("module", "system", "user").mapInArrow(run, "module string, markdown string, error string")
