"""The derived source corpus: deterministic code-like files made from ``documents``.

The test tables hold prose; the analyser needs files.  Every document becomes
one file whose path, imports, symbols and planted secrets follow from its id by
arithmetic.  The expressions are portable SQL text, so that Spark and DuckDB
build the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.session import table


def _choose(expr: str, options: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(options))
    return f"(CASE {expr} % {len(options)} {arms} END)"


TOPS = ["src", "lib", "web"]
DIRS = ["services", "controllers", "auth", "billing", "db", "tests", "settings", "handlers", "core", "payment", "docs", "api", "misc"]
STEMS = ["main", "user_service", "InvoiceModel", "cache_client", "report", "session_util", "engine"]
SUFFIXES = [".py", ".ts", ".py", ".js", ".md", ".json", ".sh", ".sql"]


def stem_of(i: str) -> str:
    return f"concat({_choose(i, STEMS)}, '_', CAST({i} AS STRING))"


def suffix_of(i: str) -> str:
    return _choose(i, SUFFIXES)


def path_of(i: str) -> str:
    return f"concat({_choose(i, TOPS)}, '/', {_choose(i, DIRS)}, '/', {stem_of(i)}, {suffix_of(i)})"


_NL = "chr(10)"
#: (condition, target) of each import a file makes; targets are ids below n.
TARGETS = [("i % 5 = 0", "((i * 7 + 3) % n)"), ("i % 4 <> 0", "((i + 1) % n)"), ("i % 10 = 1", "(i - 1)"), ("i % 10 = 0", "((i + 1) % n)")]


def _secret(i: str) -> str:
    """A planted secret line, or nothing; assembled so that no literal looks like one."""
    fakes = [
        "concat('key = ', chr(39), 'AK', 'IA', 'ABCDEFGHIJKLMNOP', chr(39))",
        "concat('t = ', chr(39), 'gh', 'p_', repeat('a1B2', 9), chr(39))",
        "concat('pass', 'word = ', chr(39), 'hunter2hunter2', chr(39))",
        "concat('u = ', chr(39), 'postgres', '://bob:pw@host/db', chr(39))",
        "concat('s = ', chr(39), 'sk', '_live_', repeat('Zx9', 9), chr(39))",
        "concat('g = ', chr(39), 'AI', 'za', repeat('Ab3_x', 7), chr(39))",
    ]
    arms = " ".join(f"WHEN {k} THEN concat({x}, {_NL})" for k, x in enumerate(fakes))
    return f"(CASE {i} % 11 {arms} ELSE '' END)"


def _py(i: str) -> str:
    imports = ", ".join(
        f"(CASE WHEN {c} THEN concat('from ', {stem_of(t)}, ' import thing', {_NL}) ELSE '' END)" for c, t in TARGETS
    )
    return (
        f"concat('import os', {_NL}, 'import redis.client', {_NL}, {imports}, "
        f"'class Invoice', CAST({i} AS STRING), ':', {_NL}, '    def charge_customer(self, order):', {_NL}, "
        f"'        if order and order.total:', {_NL}, '            return order', {_NL}, "
        f"'async def load_user_', CAST({i} AS STRING), '():', {_NL}, '    pass', {_NL}, {_secret(i)}, "
        f"(CASE WHEN {i} % 6 = 0 THEN concat('if __name__ == ', chr(34), '__main__', chr(34), ': pass', {_NL}) ELSE '' END), "
        f"'# ', replace(body, {_NL}, concat({_NL}, '# ')))"
    )


def _js(i: str) -> str:
    imports = ", ".join(
        f"(CASE WHEN {c} THEN concat('import {{ thing }} from ', chr(34), './', {stem_of(t)}, chr(34), ';', {_NL}) ELSE '' END)"
        for c, t in TARGETS
    )
    return (
        f"concat('import axios from ', chr(34), 'axios/lib', chr(34), ';', {_NL}, "
        f"'const fs = require(', chr(34), 'node:fs', chr(34), ');', {_NL}, {imports}, "
        f"'export class OrderView', CAST({i} AS STRING), ' {{}}', {_NL}, "
        f"'export async function fetchOrders() {{', {_NL}, '    if (a && b || c) {{ return 1; }}', {_NL}, '}}', {_NL}, "
        f"'const maxRetries = 3;', {_NL}, 'export {{ fetchOrders as orders, maxRetries }};', {_NL}, "
        f"'export default fetchOrders', {_NL}, {_secret(i)}, "
        f"(CASE WHEN {i} % 6 = 1 THEN concat('server.listen(80)', {_NL}) ELSE '' END), "
        f"'// ', replace(body, {_NL}, concat({_NL}, '// ')))"
    ).replace("{{", "{").replace("}}", "}")


def source_of(i: str) -> str:
    sfx = suffix_of(i)
    return f"(CASE WHEN {sfx} = '.py' THEN {_py(i)} WHEN {sfx} IN ('.ts', '.js') THEN {_js(i)} ELSE concat({_secret(i)}, body) END)"


#: Relation ``corpus(doc_id, path, src)`` for DuckDB; Spark uses the same expressions.
CORPUS_SQL = f"""
corpus_in AS (SELECT doc_id, doc_id AS i, coalesce(text, '') AS body, (SELECT count(*) FROM documents) AS n FROM documents WHERE doc_id IS NOT NULL),
corpus AS (SELECT doc_id, {path_of('i')} AS path, {source_of('i')} AS src FROM corpus_in)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, src`` of every document with an id."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    base = docs.where("doc_id is not null").select(
        "doc_id", F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("body"), F.lit(n).alias("n")
    )
    return base.selectExpr("doc_id", f"{path_of('i')} AS path", f"{source_of('i')} AS src")
