"""Language identification by cross-parsing entropy.

One suffix automaton per language holds every substring of a bounded sample
of labelled text.  A document is parsed greedily against each automaton: a
phrase is the longest piece that occurs in the language's sample, and the next
phrase starts where it ends.  A language that explains the text needs few,
long phrases; ``phrases * log2(sample size) / characters`` (bits a character)
is the normalised count, and the language with the least wins.

Texts are parsed in blocks of ``BLOCK`` characters, so that no phrase crosses
a block boundary; all blocks of a batch advance in lock step through NumPy
transition tables, one column at a time and all languages at once.  Every
character of every text is parsed.

Defined results: a null, empty or letterless text has no language (``lang``
null, ``accepted`` false); a text above ``max_bits`` for its best language is
rejected too; equal scores go to the alphabetically first language; repeated
rows each get the same answer; an empty table gives an empty result; rows
with a null ``doc_id`` are judged like others; only ``doc_id`` and ``text``
are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from corpusloom.llm.textkit import column, pieces, slices

BLOCK = 512
#: Bounds of the labelled sample: documents and characters a language.
SAMPLE_DOCS = 48
SAMPLE_CHARS = 40_000
#: Of longer documents the beginning is taken into the sample, and only where shorter ones do not fill it.
SAMPLE_DOC_CHARS = 6_000
MAX_BITS = 6.0
SPACE, ALIEN = 1, 0
SCHEMA = "doc_id long, lang string, bits double, runner_up string, margin double, accepted boolean"


def _letters(text: str) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def build_automaton(s: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``s``; state 0 is the root."""
    nxt: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in s:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class CrossParser:
    """Tables of all languages' automata, and the batch parser over them."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        clean = {k: " ".join(_letters(v)) for k, v in samples.items()}
        self.langs = [k for k in self.langs if clean[k]]
        chars = sorted({c for k in self.langs for c in clean[k]} - {" "})
        self.classes = {c: i + 2 for i, c in enumerate(chars)}
        self.width = len(chars) + 2
        lut = np.full(0x110000, SPACE, dtype=np.int32)
        for lo in range(0, 0x110000, 0x1000):
            if lo >= 0x30000:  # no letters in use above the ideographic planes
                break
            for cp in range(lo, lo + 0x1000):
                if chr(cp).isalpha():
                    lut[cp] = ALIEN
        for c, i in self.classes.items():
            lut[ord(c)] = i
        self.lut = lut[:0x30000].astype(np.uint16)
        tables, self.roots, base = [], [], 0
        for k in self.langs:
            nxt = build_automaton(clean[k])
            n = len(nxt)
            t = np.full((n, self.width), -1, dtype=np.int64)
            for s, edges in enumerate(nxt):
                for c, to in edges.items():
                    t[s, self.classes.get(c, SPACE)] = to
            root = np.where(t[0] >= 0, t[0], 0)
            lost = np.where(t[0] >= 0, 0, 1)
            miss = t < 0
            to = np.where(miss, root, t)
            cost = np.where(miss, 1 + lost, 0)
            cost[0] = lost
            # A state id is stored times the table width, so that a step is one addition and one gather.
            tables.append((((to + base) * self.width << 2) | cost).astype(np.int64))
            self.roots.append(base * self.width)
            base += n
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int64)
        if len(self.table) and int(self.table.max()) < 2**31:
            self.table = self.table.astype(np.int32)
        self.bits = np.array([np.log2(max(2, len(clean[k]))) for k in self.langs])

    def encode(self, text: str | None) -> np.ndarray:
        """Classes of the lower-cased characters; a run of non-letters is one space."""
        if not text:
            return np.zeros(0, np.uint16)
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        k = self.lut[np.minimum(cp, len(self.lut) - 1)]
        space = k == SPACE
        k = k[~(space & np.concatenate([[True], space[:-1]]))]
        return k[:-1] if len(k) and k[-1] == SPACE else k

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and each text's characters."""
        codes = [self.encode(t) for t in texts]
        lens = np.array([len(c) for c in codes], dtype=np.int64)
        n_blocks = -(-lens // BLOCK)
        total = int(n_blocks.sum())
        out = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        if not total or not self.langs:
            return out, lens
        flat = np.concatenate(codes)
        doc = np.repeat(np.arange(len(texts)), n_blocks)
        k = np.arange(total) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        begin = np.repeat(np.cumsum(lens) - lens, n_blocks) + k * BLOCK
        size = np.minimum(BLOCK, np.repeat(lens, n_blocks) - k * BLOCK)
        order = np.argsort(-size, kind="stable")
        doc, begin, size = doc[order], begin[order], size[order]
        roots = np.array(self.roots, dtype=self.table.dtype)[:, None]
        state = np.repeat(roots, total, axis=1)
        cost = np.zeros((len(self.langs), total), dtype=np.int32)
        live = np.searchsorted(-size, -np.arange(BLOCK), side="left")
        for j in range(int(size[0])):
            m = int(live[j])
            c = flat[begin[:m] + j].astype(self.table.dtype)
            v = self.table[state[:, :m] + c]
            cost[:, :m] += v & 3
            state[:, :m] = v >> 2
        cost += state != roots  # the phrase still open
        for i in range(len(self.langs)):
            out[:, i] = np.bincount(doc, weights=cost[i], minlength=len(texts)).astype(np.int64)
        return out, lens

    def judge(self, texts: list[str | None], max_bits: float) -> dict[str, list]:
        n, lens = self.phrases(texts)
        cols: dict[str, list] = {k: [] for k in ("lang", "bits", "runner_up", "margin", "accepted")}
        if not self.langs:
            for k in cols:
                cols[k] = [False if k == "accepted" else None] * len(texts)
            return cols
        score = n * self.bits / np.maximum(lens, 1)[:, None]
        rank = np.argsort(score, axis=1, kind="stable")
        for i in range(len(texts)):
            if not lens[i]:
                row = (None, None, None, None, False)
            else:
                a = rank[i, 0]
                b = rank[i, 1] if len(self.langs) > 1 else None
                best = float(score[i, a])
                row = (
                    self.langs[a],
                    best,
                    None if b is None else self.langs[b],
                    None if b is None else float(score[i, b]) / best - 1.0,
                    best <= max_bits,
                )
            for k, v in zip(cols, row):
                cols[k].append(v)
        return cols


def sample(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Labelled text of each language: whole documents in hash order of their id, then beginnings of longer ones.

    The sample is bounded by ``docs_per_lang`` documents, of each at most
    ``SAMPLE_DOC_CHARS`` characters, and by ``chars`` characters, whatever the
    input.  A language of long documents only is sampled from these.
    Only the id, the label and the length are ranked; texts are read for the
    chosen ids alone.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    w = Window.partitionBy("lang").orderBy(F.col("n") > SAMPLE_DOC_CHARS, "h", "doc_id")
    ids = (
        rows.select("doc_id", "lang", F.length("text").alias("n"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
        .where("n > 0")
        .withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= docs_per_lang)
        .select("doc_id", "lang", "t", "r")
        .collect()
    )
    if not ids:
        return {}
    key = ["doc_id", "lang", "t"]
    want = docs.sparkSession.createDataFrame([tuple(r[c] for c in key) for r in ids], "doc_id long, lang string, t long").distinct()
    # one row of each key, however often it is repeated
    got = (
        rows.select("doc_id", "lang", F.xxhash64("text").alias("t"), F.substring("text", 1, SAMPLE_DOC_CHARS).alias("text"))
        .join(F.broadcast(want), key)  # docs_per_lang rows a language
        .groupBy(*key)
        .agg(F.min("text").alias("text"))
        .collect()
    )
    rank = {(r.doc_id, r.lang): r.r for r in ids}
    parts: dict[str, list[str]] = {}
    for r in sorted(
        (r for r in got if (r.doc_id, r.lang) in rank), key=lambda r: (r.lang, rank[r.doc_id, r.lang], r.doc_id, r.text)
    ):
        if sum(map(len, parts.setdefault(r.lang, []))) < chars:
            parts[r.lang].append(r.text)
    return {k: " ".join(v) for k, v in parts.items()}


def identify(docs: DataFrame, samples: dict[str, str] | None = None, max_bits: float = MAX_BITS) -> DataFrame:
    """``doc_id, lang, bits, runner_up, margin, accepted`` for every row of ``docs``."""
    parser = CrossParser(sample(docs) if samples is None else samples)
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in slices(batches):
            texts = column(b, "text")
            cols: dict[str, list] = {}
            for s in pieces(texts):
                for k, v in p.judge(texts[s], max_bits).items():
                    cols.setdefault(k, []).extend(v)
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).cast(pa.int64()),
                        pa.array(cols["lang"], pa.string()),
                        pa.array(cols["bits"], pa.float64()),
                        pa.array(cols["runner_up"], pa.string()),
                        pa.array(cols["margin"], pa.float64()),
                        pa.array(cols["accepted"], pa.bool_()),
                    ],
                    names=["doc_id", "lang", "bits", "runner_up", "margin", "accepted"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, samples: dict[str, str] | None = None, max_bits: float = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, ``lang`` set to it.

    Works on the rows themselves (no join), so repeated and null ids are fine.
    All columns of ``docs`` are kept in order.
    """
    parser = CrossParser(sample(docs) if samples is None else samples)
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in slices(batches):
            texts = column(b, "text")
            lang: list = []
            ok: list = []
            for s in pieces(texts):
                got = p.judge(texts[s], max_bits)
                lang += got["lang"]
                ok += got["accepted"]
            at = b.schema.get_field_index("lang")
            b = b.set_column(at, "lang", pa.array(lang, pa.string()))
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
