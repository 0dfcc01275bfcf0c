"""Benchmark decontamination by CGK embedding and bit sampling (operator 1).

Texts are strings of words. The random walk of Chakraborty, Goldenberg and Koucky maps such a
string to a longer one: at each step it writes the word it stands on and moves on or stays by
a random bit of that word and step; strings a few edits apart then differ in few places, so
edit distance becomes Hamming distance. Every table samples a few places of an embedding and
hashes what stands there. All windows of every benchmark item are put into the tables; windows
of the documents look them up. A hit whose surroundings have too few of the item's words is
passed over, which is exact; the others are verified by the exact edit distance between the
item and the best stretch of the document around the hit.

Windows are sized by the item, but have eight words at most: the share of edits in the best of
an item's windows falls with their number, and with a fixed window the number of sampled
places and tables suits every item. Short items take windows of half their length or so. A
document's window with more than a quarter of words that no item of its kind has is not looked
up. Items of one to four words allow no edits at 0.8 and are matched exactly: equal strings have
equal embeddings.

The benchmark's tables are broadcast in blocks of at most BLOCK_WORDS words, one pass over the
documents for each, so what a task holds never grows with the data. A worker builds a block's
tables once.

Nulls: a null text matches nothing and stays; a row without doc_id is judged by its text, and an
item without item_id by its text too, with a null item_id in the report. Items without a word
are left out. Repeated items and documents are matched one by one; of equally good passages of
a document the first counts. Very long texts are searched whole.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palaver.llm import text as tx
from palaver.llm.shared import arrow_rows, lean

SIMILARITY, LEAST_WORDS = 0.8, 1
#: By window length: random walks and sampled places of a table; tables of each walk.
WALKS, PLACES, TABLES = {4: 8, 6: 6, 8: 5}, {4: 3, 6: 4, 8: 6}, 4
BLOCK_WORDS = 200_000
U64 = np.uint64
#: Bits of a word's slot in a level's vocabulary, and of a hash's slot in a table's mask.
_BITS, _MASK = 20, 18


def width_for(n: int) -> int:
    """Words of a window of an item of n words."""
    return n if n < 5 else 4 if n < 12 else 6 if n < 16 else 8


def stride(width: int) -> int:
    """Words between a document's windows; items have windows everywhere."""
    return 2 if width >= 8 else 1


def edits(n, similarity: float):
    """Allowed edits between an item of n words and a passage."""
    return np.floor((1 - similarity) * n + 1e-9).astype(np.int64)


class Walks:
    """The shared randomness of a window length: bits by word and step, sampled places by table."""

    def __init__(self, width: int, walks: int | None = None, tables: int = TABLES, seed: int = 7):
        exact, walks = width not in PLACES, walks or WALKS.get(width, 1)
        self.width, self.steps = width, 2 * width
        self.seeds = tx.mix(np.arange(1, (1 if exact else walks) + 1, dtype=np.uint64) * U64(0xD1342543DE82EF95) + U64(seed))
        rng, places = np.random.Generator(np.random.PCG64([seed, width])), PLACES.get(width, width)
        self.picks = [[np.sort(rng.choice(self.steps, places, replace=False)) for _ in range(1 if exact else tables)] for _ in self.seeds]
        self.odd = tx.mix(np.arange(self.steps, dtype=np.uint64) + U64(99)) | U64(1)

    def keys(self, words: np.ndarray, starts: np.ndarray):
        """For each walk and table: hashes of the windows words[start:start + width].

        A walk is cut after 2 * width steps, where few have left their window; beyond it, 0 is written.
        """
        padded = np.append(words, U64(0))
        starts = starts.astype(np.int32)
        last = starts + np.int32(self.width)
        for k, own in enumerate(self.seeds):
            coins = tx.mix(padded ^ own)
            wanted, taken, at = {int(j) for p in self.picks[k] for j in p}, {}, starts.copy()
            for j in range(max(wanted) + 1):
                if j in wanted:
                    taken[j] = np.where(at < last, padded[at], U64(0)) * self.odd[j]
                moves = ((coins >> U64(j)) & U64(1)).astype(np.int8)
                at = np.minimum(at + moves[at], last)
            for t, picks in enumerate(self.picks[k]):
                h = np.full(len(starts), U64(self.width * 1_000_003 + k * 1009 + t + 1))
                for j in picks.tolist():
                    h += taken[j]
                yield tx.mix(h)


class Tables:
    """One block of the benchmark: its words and its hash tables."""

    def __init__(self, ids: list, texts: list, similarity: float):
        hashes, rows, _, _ = tx.words(tx.plain(pa.array(texts, pa.string())))
        self.ids, self.similarity = ids, similarity
        self.items = [hashes[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        self.allowed = edits(np.diff(rows), similarity)
        self.levels = []
        count = np.diff(rows)
        widths = np.array([width_for(int(n)) for n in count])
        for width in sorted(set(widths[count >= LEAST_WORDS].tolist())):
            own = np.flatnonzero((widths == width) & (count >= LEAST_WORDS))
            each = count[own] - width + 1
            item = np.repeat(own, each)
            offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            walks, tables = Walks(width), []
            for h in walks.keys(hashes, rows[item] + offset):
                order = np.argsort(h, kind="stable")
                mask = np.zeros(1 << _MASK, bool)
                mask[(h >> U64(64 - _MASK)).astype(np.int64)] = True
                tables.append((h[order], order, mask))
            known = np.zeros(1 << _BITS, bool)
            for i in own:
                known[(self.items[i] >> U64(64 - _BITS)).astype(np.int64)] = True
            self.levels.append((width, walks, item, offset, known, tables))

    def candidates(self, words: np.ndarray, rows: np.ndarray):
        """(row, item, position of the item's start in words if nothing is edited before the window) of every hit, once each."""
        slot, found = (words >> U64(64 - _BITS)).astype(np.int64), []
        for width, walks, item, offset, vocabulary, tables in self.levels:
            known = np.concatenate(([0], np.cumsum(vocabulary[slot], dtype=np.int64)))
            grid = stride(width)
            count = np.maximum(0, (np.diff(rows) - width) // grid + 1)
            total = np.concatenate(([0], np.cumsum(count)))
            row = np.repeat(np.arange(len(count)), count)
            starts = rows[:-1][row] + (np.arange(total[-1]) - total[:-1][row]) * grid
            some = known[starts + width] - known[starts] >= width - width // 4
            row, starts = row[some], starts[some]
            if not len(starts):
                continue
            for h, (sorted_, order, mask) in zip(walks.keys(words, starts), tables, strict=True):
                near = np.flatnonzero(mask[(h >> U64(64 - _MASK)).astype(np.int64)])
                if not len(near):
                    continue
                lo, hi = np.searchsorted(sorted_, h[near]), np.searchsorted(sorted_, h[near], "right")
                n = hi - lo
                w = np.repeat(near, n)
                e = order[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                if len(w):
                    found.append(np.stack((row[w], item[e], starts[w] - offset[e]), axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def matches(self, words: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, words, edits) of the best passage of each row and item within the allowed edits."""
        hits, best = self.candidates(words, rows), {}
        for i in np.unique(hits[:, 1]):
            own = self.items[i]
            n, most = len(own), int(self.allowed[i])
            at = hits[hits[:, 1] == i]
            # Hits of one row whose stretches overlap heavily need one comparison.
            key = np.unique(np.stack((at[:, 0], (at[:, 2] - rows[at[:, 0]]) // (n // 2 + 1)), axis=1), axis=0)
            row = key[:, 0]
            lo = np.maximum(rows[row], rows[row] + key[:, 1] * (n // 2 + 1) - most)
            hi = np.minimum(rows[row + 1], rows[row] + (key[:, 1] + 1) * (n // 2 + 1) + n + most)
            ends = np.cumsum(hi - lo)
            inside = words[np.arange(ends[-1]) + np.repeat(lo - ends + (hi - lo), hi - lo)]
            of_item = np.concatenate(([0], np.cumsum(np.isin(inside, own))))
            enough = of_item[ends] - of_item[ends - (hi - lo)] >= n - most
            row, lo, hi = row[enough], lo[enough], hi[enough]
            step = max(1, (1 << 20) // n)
            for part in range(0, len(row), step):
                cut = slice(part, part + step)
                cost, start, end = best_stretch(own, words, lo[cut], hi[cut])
                for r, c, s, e in zip(row[cut], cost, start, end, strict=True):
                    if c <= most and ((r, i) not in best or (c, s) < best[r, i][:2]):
                        best[r, i] = (c, s, e)
        return [(int(r), int(i), int(s - rows[r]), int(e - s), int(c)) for (r, i), (c, s, e) in best.items()]


def best_stretch(item: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Least edit distance between item and any stretch of words[lo:hi], with its start and end."""
    most = int((hi - lo).max(initial=0))
    at = lo[:, None] + np.arange(most)
    inside = at < hi[:, None]
    region = np.where(inside, words[np.minimum(at, len(words) - 1)], U64(0))
    column = np.arange(most + 1)
    # Cost and start are one number, so that ties take the latest start, hence the shortest stretch.
    big = most + 2
    state = np.tile(big - 1 - column, (len(lo), 1)).astype(np.int64)
    for w in item:
        new = np.empty_like(state)
        new[:, 0] = state[:, 0] + big
        differs = ~((region == w) & inside)
        new[:, 1:] = np.minimum(state[:, :-1] + differs * big, state[:, 1:] + big)
        new = np.minimum.accumulate(new - column * big, axis=1) + column * big
        state = new
    state[:, 1:][~inside] = np.iinfo(np.int64).max
    end = state.argmin(axis=1)
    least = state[np.arange(len(lo)), end]
    return least // big, lo + (big - 1 - least % big), lo + end


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS):
    """Lists of (item_id, text) with at most `most` words each (a longer item is a list of its own)."""
    rows, size = [], 0
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    for r in items.toLocalIterator():
        n = len(r.text) // 2 + 1  # a word and its space have two characters at least
        if rows and size + n > most:
            yield rows
            rows, size = [], 0
        rows.append((r.item_id, r.text))
        size += n
    if rows:
        yield rows


_built: dict[str, Tables] = {}


def _sent(docs: DataFrame, block: list, similarity: float):
    """A function that gives the block's tables inside a task, built once in each worker."""
    sent, key = docs.sparkSession.sparkContext.broadcast(tuple(zip(*block, strict=True))), uuid.uuid4().hex

    def tables() -> Tables:
        if key not in _built:
            _built.clear()
            _built[key] = Tables(*map(list, sent.value), similarity)
        return _built[key]

    return tables


MATCH = "doc_id long, item_id long, first_word long, words long, item_words long, edits long"


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and benchmark item that it holds: the best passage and its edits."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    arrow_rows(docs.sparkSession, 2000)
    out = None
    for block in blocks(benchmark):

        def run(batches, tables=_sent(docs, block, similarity)):
            index = tables()
            for b in batches:
                for at, part in tx.chunks(b.column(1), 1 << 20):
                    words, rows, _, _ = tx.words(tx.plain(part))
                    got = index.matches(words, rows)
                    if got:
                        row, item, first, n, cost = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).slice(at, len(part)).take(pa.array(row, pa.int64())), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array([len(index.items[i]) for i in item], pa.int64()), pa.array(cost, pa.int64())],
                            ["doc_id", "item_id", "first_word", "words", "item_words", "edits"],
                        )

        found = texts.mapInArrow(lean(run), MATCH)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], MATCH)
    return out.withColumn("similarity", 1 - F.col("edits") / F.col("item_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; one pass without a shuffle for each block."""
    arrow_rows(docs.sparkSession, 2000)
    at_text = docs.columns.index("text")
    for block in blocks(benchmark):

        def run(batches, tables=_sent(docs, block, similarity)):
            index = tables()
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for at, part in tx.chunks(b.column(at_text), 1 << 20):
                    words, rows, _, _ = tx.words(tx.plain(part))
                    clean[[at + m[0] for m in index.matches(words, rows)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
