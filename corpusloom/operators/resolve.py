"""Import resolution as one equi-join against a typed lookup table.

Every distinct specifier expands to an ordered list of candidate keys; the table maps
``(kind, key)`` to a file.  Kinds: ``f`` the file itself, ``d`` a directory's
index file, ``k`` any alias of a file (path, name, stem, parent/stem, ...).
The first candidate that has a row wins (``min_by``).  Everything is resolved
against the scanned files, never against the disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import text as X
from corpusloom.session import grows

INDEX_FILES = [f"index.{x}" for x in "py ts tsx js jsx mjs cjs".split()] + ["__init__.py"]
EXTENSIONS = [f".{x}" for x in "py ts tsx js jsx mjs cjs json".split()]
STDLIB = sorted(
    """abc array ast asyncio bisect collections contextlib copy csv dataclasses datetime decimal email enum fractions
    functools hashlib heapq http importlib inspect io itertools json logging math multiprocessing os pathlib pkgutil queue
    random re selectors shutil socket sqlite3 ssl statistics struct subprocess sys tempfile threading time tomllib
    traceback types typing typing_extensions unittest urllib uuid warnings weakref""".split()
)


CANDIDATES = "array<struct<rank:int,kind:string,key:string>>"


def file_index(files: DataFrame, root: str = "/repo") -> DataFrame:
    """``key, rel``: all lookup keys of a file; of files that share a key the greatest path wins."""
    name, size = "element_at(split(path, '/'), -1)", "size(split(path, '/'))"
    stem = f"regexp_replace({name}, '(?<=.)\\\\.[^.]+$', '')"
    parent = f"case when {size} > 1 then element_at(split(path, '/'), -2) else {X.quoted(root.rsplit('/', 1)[-1])} end"
    folder = f"regexp_replace(concat({X.quoted(root + '/')}, path), '/[^/]*$', '')"
    keys = f"array(path, {name}, {stem}, concat_ws('/', {parent}, {stem}), {folder}, concat_ws('/', {parent}, {name}))"
    return files.selectExpr("path", f"explode(array_distinct({keys})) as key").groupBy("key").agg(F.max("path").alias("rel"))


def lookup_table(files: DataFrame, index: DataFrame) -> DataFrame:
    """``kind, key, rel`` for the three kinds of candidates."""
    own = files.select(F.lit("f").alias("kind"), F.col("path").alias("key"), F.col("path").alias("rel"))
    alias = index.select(F.lit("k").alias("kind"), "key", "rel")
    above = f"transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), n -> concat_ws('/', slice({X.sql_dirs()}, 1, n)))"
    folders = files.selectExpr(f"explode({above}) as dir").where("dir != ''").distinct()
    tries = ", ".join(f"concat(dir, '/{x}'), '{x.rsplit('.', 1)[0]}'" for x in INDEX_FILES) + ", element_at(split(dir, '/'), -1)"
    probes = folders.selectExpr("dir", f"posexplode(array({tries})) as (pos, key)")
    hit = probes.join(grows(index), "key").groupBy("dir").agg(F.min_by("rel", "pos").alias("rel"))
    return own.unionByName(alias).unionByName(hit.select(F.lit("d").alias("kind"), F.col("dir").alias("key"), "rel"))


def normal_path(path: str) -> str:
    """SQL of a path with ``.`` and ``..`` resolved; null if it leaves the root."""
    up = "case when size(acc) > 0 then slice(acc, 1, greatest(size(acc) - 1, 0)) end"
    step = f"case when p = '' or p = '.' then acc when p = '..' then {up} else array_append(acc, p) end"
    return f"aggregate(split({path}, '/'), cast(array() as array<string>), (acc, p) -> {step}, a -> concat_ws('/', a))"


def expansion(base: str, first: int) -> str:
    """SQL array of candidates ``rank, kind, key`` of one path without extension knowledge, ranked from ``first``.

    A key that comes up again under the same kind is left out, as its first rank decides.
    """
    name = f"element_at(split({base}, '/'), -1)"
    bare = f"regexp_replace({base}, '(?<=[^/])\\\\.[^./]+$', '')"
    stem = f"regexp_replace({name}, '(?<=.)\\\\.[^.]+$', '')"
    out = [("f", base), ("d", base), ("k", f"concat({bare}, '{EXTENSIONS[0]}')"), ("k", stem)]
    out += [("k", f"concat({bare}, '{x}')") for x in EXTENSIONS[1:]] + [("k", name)]
    items = ", ".join(f"struct({first + i} as rank, '{k}' as kind, {c} as key)" for i, (k, c) in enumerate(out))
    none = f"cast(array() as {CANDIDATES})"
    return f"case when {base} is null or {base} = '' then {none} else array({items}) end"


def alias_base(alias: str, target: str) -> str:
    """SQL of the target path if the alias prefixes the specifier, else null."""
    q = X.quoted
    rest = f"regexp_replace(substr(s, {len(alias) + 1}), '^/+', '')"
    return f"case when s = {q(alias)} or startswith(s, {q(alias + '/')}) then {normal_path(f'concat({q(target + chr(47))}, {rest})')} end"


def candidates(
    specs: DataFrame, aliases: list[tuple[str, str]] | None = None, bare_names: DataFrame | None = None
) -> DataFrame:
    """``is_py, folder, s, rank, kind, key`` of distinct ``is_py, folder, s`` (the bare specifier).

    A head among ``bare_names`` (``name``) is not tried.

    Ranks grow with the attempt: aliases (longest first), relative path, head
    (10000s), dotted path, path.  Rank 0 is a probe that voids the head attempt.
    """
    aliases = sorted(aliases or [], key=lambda x: (-len(x[0]), x[0]))
    head = "split(split(s, '/')[0], '\\\\.')[0]"
    dots = "length(s) - length(regexp_replace(s, '^\\\\.+', ''))"
    rest = "replace(regexp_replace(s, '^\\\\.+', ''), '.', '/')"
    above = f"concat(folder, repeat('/..', cast(greatest({dots} - 1, 0) as int)), '/', {rest})"
    beside = "concat(folder, '/', s)"
    bases = {
        **{f"alias_{i}": alias_base(a, t) for i, (a, t) in enumerate(aliases)},
        "relative": f"case when not startswith(s, '.') then null when is_py then "
        f"{normal_path(above)} else {normal_path(beside)} end",
        "head": f"case when not startswith(s, '.') then {head} end",
        "dotted": "case when not startswith(s, '.') and is_py then replace(s, '.', '/') end",
        "plain": "case when not startswith(s, '.') then s end",
    }
    first = {**{f"alias_{i}": 10 + 50 * i for i in range(len(aliases))}, "relative": 5000, "head": 10000, "dotted": 20000, "plain": 30000}
    probe = f"case when head is not null then array(struct(0 as rank, 'k' as kind, head as key)) else cast(array() as {CANDIDATES}) end"
    based = specs.where("s != '' and not startswith(s, 'node:')").selectExpr(
        "is_py", "folder", "s", *(f"{sql} as {name}" for name, sql in bases.items())
    )
    if bare_names is not None:
        names = bare_names.select(F.col("name").alias("head"), F.lit(True).alias("bare")).distinct()
        based = based.join(grows(names), "head", "left").withColumn("head", F.expr("case when bare is null then head end"))
    every = ", ".join([probe, *(expansion(name, first[name]) for name in bases)])
    return based.selectExpr("is_py", "folder", "s", f"inline(concat({every}))")


def resolve(
    specs: DataFrame,
    files: DataFrame,
    aliases: list[tuple[str, str]] | None = None,
    bare_names: DataFrame | None = None,
    root: str = "/repo",
) -> DataFrame:
    """``specs`` (path, pos, spec, base) with ``rel``, null where nothing in ``files`` matches.

    What a specifier means depends on the language and, if it is relative, on
    the folder; so each such combination is resolved once, however many files
    import it.
    """
    table = lookup_table(files.select("path"), file_index(files.select("path"), root))
    bare = "regexp_replace(trim(spec), '^[\"\\']+|[\"\\']+$', '')"
    folder = f"case when startswith(s, '.') then array_join({X.sql_dirs()}, '/') else '' end"
    keyed = specs.withColumns({"is_py": F.lower(X.suffix("path")) == ".py", "s": F.expr(bare)}).withColumn("folder", F.expr(folder))
    hits = candidates(keyed.select("is_py", "folder", "s").distinct(), aliases, bare_names).join(grows(table), ["kind", "key"])
    best = hits.groupBy("is_py", "folder", "s").agg(
        F.expr("max(rank = 0) as known"),
        F.expr("min_by(rel, case when rank > 0 then rank end) as any_rel"),
        F.expr("min_by(rel, case when rank > 0 and not (rank >= 10000 and rank < 20000) then rank end) as rest_rel"),
    )
    chosen = best.selectExpr("is_py", "folder", "s", "case when known then rest_rel else any_rel end as rel")
    return keyed.join(grows(chosen), ["is_py", "folder", "s"], "left").select(*specs.columns, "rel")


def import_specs(features: DataFrame) -> DataFrame:
    """``path, pos, spec, base`` of every import."""
    return features.select("path", F.posexplode(F.arrays_zip("specs", "bases")).alias("pos", "x")).select(
        "path", "pos", F.col("x.specs").alias("spec"), F.col("x.bases").alias("base")
    )


def dependencies(resolved: DataFrame) -> DataFrame:
    """``path, internal, external``: sorted distinct files and packages."""
    py = F.lower(X.suffix("path")) == ".py"
    outside = F.col("rel").isNull() & (F.coalesce("base", F.lit("")) != "")
    package = F.when(outside & F.when(py, ~F.col("base").isin(STDLIB)).otherwise(~F.col("spec").startswith("node:")), F.col("base"))
    return resolved.groupBy("path").agg(
        F.array_sort(F.collect_set("rel")).alias("internal"), F.array_sort(F.collect_set(package)).alias("external")
    )


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` without self edges."""
    return (
        resolved.where("rel is not null and rel != path")
        .select(F.col("path").alias("src"), F.col("rel").alias("dst"))
        .distinct()
    )
