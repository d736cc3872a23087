"""Fill-in-middle transformation: DuckDB inside mapInArrow.

Every Arrow batch is registered as a table of a DuckDB connection that lives as
long as the task. SQL cuts the texts into tokens (regexp_extract_all), joins
slices of them (list_slice, array_to_string), draws cuts and forms from sha256 of
the row's id, and hands back Arrow columns; no row passes through Python. Batches
are bounded in bytes, one thread serves a task, and DuckDB writes nothing to disk.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import bound_batches, texts

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: A run of ASCII letters or any other code point.
TOKEN = "[A-Za-z]+|[^A-Za-z]"

#: Columns that each step adds, with their Spark types.
MADE = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}
RESTORED = {"restored": "string"}
DIGESTS = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that can be found again: none is empty, lies in another or ends as another (or itself) begins."""
    for (i, a), (j, b) in combinations_with_replacement(enumerate(marks), 2):
        if not a or not b or (i != j and (a in b or b in a)) or any(x[-k:] == y[:k] for x, y in ((a, b), (b, a)) for k in range(1, min(len(a), len(b)))):
            raise ValueError(f"marks that cannot be told apart: {marks}")
    return marks


def format_sql(source: str, marks: tuple[str, str, str] = MARKS, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> str:
    """SQL for the columns of MADE, row by row of source(id, text)."""
    p, s, m = map(_quoted, _checked(marks))
    draw = [f"('0x' || substr(h, {8 * k + 1}, 8))::UBIGINT" for k in range(4)]
    held = " OR ".join(f"contains(body, {x})" for x in (p, s, m))
    return f"""
        SELECT n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               CASE form WHEN 'plain' THEN body WHEN 'psm' THEN concat({p}, pre, {s}, suf, {m}, mid) ELSE concat({s}, suf, {p}, pre, {m}, mid) END AS output
        FROM (SELECT body, n, form, array_to_string(list_slice(toks, 1, lo), '') AS pre, array_to_string(list_slice(toks, lo + 1, hi), '') AS mid, array_to_string(list_slice(toks, hi + 1, n), '') AS suf
              FROM (SELECT body, toks, n, least({draw[0]} % (n + 1), {draw[1]} % (n + 1))::BIGINT AS lo, greatest({draw[0]} % (n + 1), {draw[1]} % (n + 1))::BIGINT AS hi,
                           CASE WHEN body = '' OR {held} OR {draw[2]} % 100 >= {100 - int(plain_percent)} THEN 'plain' WHEN {draw[3]} % 100 < {int(spm_percent)} THEN 'spm' ELSE 'psm' END AS form
                    FROM (SELECT body, h, toks, len(toks)::BIGINT AS n
                          FROM (SELECT coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), {_quoted(TOKEN)}) AS toks, sha256(concat('{int(seed)}:', id::VARCHAR)) AS h FROM {source}))))"""


def restore_sql(source: str, marks: tuple[str, str, str] = MARKS) -> str:
    """SQL for all columns of source(form, output, ...) and the text restored from those two."""
    p, s, m = map(_quoted, _checked(marks))
    return f"""
        SELECT * EXCLUDE (body, first, tail, cut),
               CASE form WHEN 'psm' THEN concat(first, substr(tail, cut + length({m})), substr(tail, 1, cut - 1))
                         WHEN 'spm' THEN concat(substr(tail, 1, cut - 1), substr(tail, cut + length({m})), first) ELSE body END AS restored
        FROM (SELECT *, position({m} IN tail) AS cut
              FROM (SELECT *, CASE form WHEN 'psm' THEN substr(body, 1, position({s} IN body) - 1) WHEN 'spm' THEN substr(body, 1, position({p} IN body) - 1) END AS first,
                              CASE form WHEN 'psm' THEN substr(body, position({s} IN body) + length({s})) WHEN 'spm' THEN substr(body, position({p} IN body) + length({p})) END AS tail
                    FROM (SELECT *, CASE form WHEN 'psm' THEN substr(output, length({p}) + 1) WHEN 'spm' THEN substr(output, length({s}) + 1) ELSE output END AS body FROM {source})))"""


def _in_duckdb(df: DataFrame, named: dict[str, str], made: dict[str, str], sql: str, kept: list[str]) -> DataFrame:
    """df's kept columns and those that sql makes of the relation batch, whose columns are named[name] of df."""
    bound_batches(df.sparkSession)
    at = {name: df.columns.index(col) for name, col in named.items()}
    stay = [df.columns.index(c) for c in kept]
    schema = df.select(*kept, *(F.lit(None).cast(t).alias(c) for c, t in made.items())).schema
    kinds = {c: pa.string() if t == "string" else pa.int64() for c, t in made.items()}

    def run(batches):
        con = duckdb.connect(config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False})
        try:
            for batch in batches:
                con.register("batch", pa.table([batch.column(i) for i in at.values()], names=list(at)))
                out = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                new = [out.column(c).cast(kind).combine_chunks() for c, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), *new], [*kept, *kinds])
        finally:
            con.close()

    return df.mapInArrow(run, schema)


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, str, str] = MARKS, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output: whole texts rearranged around a middle.

    Cuts fall between tokens and are drawn, as the form is, from sha256 of
    "seed:id", so reruns and repeated rows agree; a null id is drawn as an empty
    one. A null text counts as empty; empty texts and those that contain a mark
    stay plain, as plain_percent of the rest do. Columns named like the new ones
    are replaced; an empty table gives an empty one. Very long texts stand in a
    batch of their own.
    """
    kept = [c for c in docs.columns if c not in MADE or c in (id_col, text_col)]
    if clash := {id_col, text_col} & set(MADE):
        raise ValueError(f"rename the columns {sorted(clash)}")
    return _in_duckdb(docs, {"id": id_col, "text": text_col}, MADE, format_sql("batch", marks, seed, plain_percent, spm_percent), kept)


def restore(made: DataFrame, *, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """made with restored: the exact text of each row, rebuilt from output and form alone.

    A null output is restored as null. A column named restored is replaced.
    """
    return _in_duckdb(made, {"form": "form", "output": "output"}, RESTORED, restore_sql("batch", marks), [c for c in made.columns if c != "restored"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of DIGESTS of each document; both steps run in one pass, so no output leaves DuckDB."""
    sql = f"SELECT n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({restore_sql('(' + format_sql('batch') + ')')})"
    return _in_duckdb(texts(docs), {"id": "doc_id", "text": "text"}, DIGESTS, sql, ["doc_id"])


#: The digests for DuckDB: outputs by position in the text, restored texts by definition.
ORACLE = """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || doc_id) AS h FROM documents),
    k AS (SELECT *, regexp_extract_all(body, '[A-Za-z]+|[^A-Za-z]') AS toks FROM t),
    u AS (SELECT *, len(toks) AS n, ('0x' || h[1:8])::UBIGINT % (len(toks) + 1) AS a, ('0x' || h[9:16])::UBIGINT % (len(toks) + 1) AS b FROM k),
    f AS (SELECT *, coalesce(list_sum(list_transform(toks[1:least(a, b)::BIGINT], lambda x: length(x))), 0)::BIGINT AS lo, coalesce(list_sum(list_transform(toks[1:greatest(a, b)::BIGINT], lambda x: length(x))), 0)::BIGINT AS hi,
                 CASE WHEN body = '' OR regexp_matches(body, '<[PSM]>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || h[25:32])::UBIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || left(body, lo) || '<S>' || substr(body, hi + 1) || '<M>' || substr(body, lo + 1, hi - lo)
                            ELSE '<S>' || substr(body, hi + 1) || '<P>' || left(body, lo) || '<M>' || substr(body, lo + 1, hi - lo) END) AS output_sha256,
           sha256(body) AS restored_sha256
    FROM f"""
