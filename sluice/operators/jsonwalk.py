"""Values of any depth in JSON, also where it stands inside other text such as the scripts of a page."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAVES = "part int, ord long, path string, name string, value string, kind string"
START = re.compile(r"[{\[]")
BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.DOTALL)
PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Rows of one Arrow batch.
ROWS = 10_000


def documents_in(text: str, after: str | None) -> Iterator[tuple[object, str | None]]:
    """(value, error) of each JSON object or array in a text, brackets balanced as the grammar has them, in order; with a
    pattern only of the first one right behind each place that it matches. Brackets that open no JSON are passed over."""
    decoder, at = json.JSONDecoder(parse_float=str, parse_int=str, parse_constant=str), 0
    places = START if after is None else re.compile(f"(?:{after})\\s*(?=[{{\\[])")
    while m := places.search(text, at):
        start = m.start() if after is None else m.end()
        try:
            value, at = decoder.raw_decode(text, start)
            yield value, None
        except RecursionError:
            yield None, "too deep"
            at = end_of(text, start)
        except ValueError:
            at = start + 1


def end_of(text: str, at: int) -> int:
    """Behind the bracket that closes the one at this place, strings left aside; the end of the text where none does."""
    depth = 0
    for m in BRACKETS.finditer(text, at):
        if m[0][0] != '"':
            depth += 1 if m[0] in "{[" else -1
            if depth == 0:
                return m.end()
    return len(text)


def leaves(value: object) -> Iterator[tuple[str, str | None, str | None, str]]:
    """(path, name, value, kind) of all that a value holds, in the order of the text, without recursion. The name is that of
    the nearest member; numbers keep their digits; empty objects and arrays are leaves without a value."""
    stack = [("$", None, value)]
    while stack:
        path, name, v = stack.pop()
        if isinstance(v, dict) and v:
            stack += [(f"{path}.{k}" if PLAIN.fullmatch(k) else f"{path}[{json.dumps(k, ensure_ascii=False)}]", k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list) and v:
            stack += [(f"{path}[{i}]", name, v[i]) for i in range(len(v) - 1, -1, -1)]
        elif isinstance(v, dict | list):
            yield path, name, None, "object" if isinstance(v, dict) else "array"
        elif v is None or isinstance(v, bool):
            yield path, name, None if v is None else str(v).lower(), "null" if v is None else "boolean"
        else:
            yield path, name, str(v), "value"


def walk(df: DataFrame, id_col: str, text_col: str, after: str | None = None) -> DataFrame:
    """A row for each value in each JSON object or array that a text holds, at any depth: the id, `part` (which of the
    text's JSON, from 0), `ord` (from 0, in the order of the text), path, name, value and kind (value, boolean, null,
    object, array; `error` for one that is too deep to read).

    after is a pattern that stands before the JSON, such as `data\\s*=`; without it all JSON of the text counts. Null texts
    and those without JSON have no rows. Of members of one object that share a name the last counts.
    """

    def run(it):
        held: list[tuple] = []

        def flushed():
            columns = list(zip(*held, strict=True))
            kinds = [ids, pa.int32(), pa.int64(), *[pa.string()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[id_col, "part", "ord", "path", "name", "value", "kind"])

        for b in it:
            ids = b.column(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for part, (value, error) in enumerate(documents_in(text, after)):
                    if error:
                        held.append((key, part, 0, "$", None, error, "error"))
                        continue
                    for order, leaf in enumerate(leaves(value)):
                        held.append((key, part, order, *leaf))
                        if len(held) >= ROWS:
                            yield flushed()
                            held.clear()
            if held:
                yield flushed()
                held.clear()

    kind = df.schema[id_col].dataType.simpleString()
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {LEAVES}")


def first_of_each(rows: DataFrame, by: str, id_name: str) -> DataFrame:
    """(by, id, part, ord): where each id, a value under this name, stands first in each text."""
    ids = rows.where((F.col("name") == id_name) & (F.col("kind") == "value"))
    first = ids.groupBy(by, F.col("value").alias("id")).agg(F.min(F.struct("part", "ord")).alias("at"))
    return first.select(by, "id", "at.part", "at.ord")
