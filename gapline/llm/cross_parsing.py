"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed against each of them:
each phrase is the longest match with the training text, the next one starts where it ended. The language that needs the fewest
phrases for each character wins. Letters are lower-cased and each run of other characters counts as one gap, so digits,
punctuation and mark-up say nothing about the language.

The model is fitted on a bounded sample: the whole texts of ``DOCS`` labelled documents of each language, chosen by a hash of the id
among those of at most ``LONGEST`` characters. It travels with the tasks, each of which builds the automata once. Texts of any length
are parsed whole, in stretches of ``STRETCH`` symbols that advance side by side. A stretch first starts at the root; then the
state in which its predecessor ended is carried into it, until both runs are in the same state (``SETTLED`` symbols mostly suffice, else
the stretch is run again), so phrases go on over the borders and their number is that of one run over the text.

Memory: for each language about twice as many states as characters learned, at most 260,000 with texts of ``LONGEST`` characters. A table
of all states and letters takes up to ``DENSE`` entries (64 MB); alphabets that need more (Chinese, Japanese, Korean) take some 24 bytes for
each step that is there, about 10 MB a language.

Defined cases: null texts and texts without a letter are ``und`` with score 0; texts of unknown letters tie, and ties go to the
language with more labelled documents (then to the one that sorts first), with score 0; without any labelled text everything is ``und``; an empty table gives an empty result;
very long texts are read whole, in stretches; repeated rows are judged each; other columns are ignored; rows without an id are judged but never learned from.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labelled documents of each language that are learned, and characters that each of these has at most.
DOCS, LONGEST = 16, 8192
#: Symbols of a stretch, and of its beginning that is read first when a state is carried into it.
STRETCH, SETTLED = 1024, 96
#: Entries up to which an automaton is a table of all states and symbols (4 bytes each).
DENSE = 1 << 24
#: Symbols parsed together.
TOGETHER = 1 << 20
UNKNOWN = "und"
GAP, FIRST = 0, 1

Model = tuple[tuple[str, str], ...]


def held_out(doc_id: Column) -> Column:
    """A quarter of all ids, of which nothing is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, docs_each: int = DOCS, longest: int = LONGEST) -> Model:
    """(language, text) pairs from the labelled documents that aren't held out: a bounded sample of every language.

    Languages with longer texts only are learned from the shortest of these.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.struct(F.greatest(F.length("text"), F.lit(longest)).alias("over"), F.xxhash64("doc_id").alias("own"))
    piece = labelled.select("lang", order.alias("h"), F.col("text").alias("piece"))
    first = F.row_number().over(W.partitionBy("lang").orderBy("h", "piece"))
    # docs_each rows for each language, one if all its texts are longer
    rows = piece.withColumn("n", first).filter((F.col("n") <= docs_each) & ((F.col("n") == 1) | (F.col("h.over") == longest))).orderBy("lang", "n").collect()
    found: dict[str, list[str]] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append(r["piece"])
    known = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    return tuple((lang, " ".join(found[lang])) for lang in sorted(found, key=lambda x: (-known.get(x, 0), x)))


class Automaton:
    """The suffix automaton of one language's training text, over the letters of that text.

    A step's code is the next state times 4 plus the phrases that the step ends: 0 where the match goes on, else 1, or 2 if the symbol
    is in no training text and so is a phrase of its own. Up to :data:`DENSE` entries the steps of all states are one table; else those
    that are there (at most three for each symbol learned) are searched in order, so memory grows with the text and not with the
    alphabet. Both give the same steps.
    """

    def __init__(self, symbols: np.ndarray, size: int):
        own = np.unique(symbols)
        # Symbols of other languages' letters are all alike here: the last one, which no state knows.
        self.local = np.full(size, len(own), np.int32)
        self.local[own] = np.arange(len(own))
        self.size = len(own) + 1
        self.states, start, letter, target = transitions(self.local[symbols].tolist())
        restart = np.full(self.size, 2, np.int64)
        at_root = start == 0
        restart[letter[at_root]] = target[at_root] * 4 + 1
        self.restart = restart.astype(np.int32)
        self.at_root = np.where(restart == 2, 1, restart).astype(np.int32)
        self.dense = self.states * self.size <= DENSE
        if self.dense:
            self.table = np.tile(self.restart, self.states)
            self.table[: self.size] = self.at_root
            self.table[start * self.size + letter] = target * 4
        else:
            key = start * self.size + letter
            order = np.argsort(key, kind="stable")
            self.key, self.target = key[order], (target[order] * 4).astype(np.int32)

    def step(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        place = at.astype(np.int64) * self.size + symbol
        if self.dense:
            return self.table[place]
        found = np.minimum(np.searchsorted(self.key, place), len(self.key) - 1)
        other = np.where(at == 0, self.at_root[symbol], self.restart[symbol])
        return np.where(self.key[found] == place, self.target[found], other)


def transitions(symbols: list[int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of states of the suffix automaton of ``symbols``, and its steps: from, symbol, to."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    start = np.array([s for s, row in enumerate(follow) for _ in row], np.int64)
    letter = np.array([c for row in follow for c in row], np.int64)
    target = np.array([t for row in follow for t in row.values()], np.int64)
    return len(follow), start, letter, target


@functools.lru_cache(maxsize=2)
def prepared(model: Model) -> tuple[np.ndarray, int, list[Automaton]]:
    """Code point to symbol, number of symbols, an automaton for each language; built once in each worker."""
    letters = sorted({c for _, text in model for c in text.lower() if c.isalpha()})
    size = FIRST + len(letters) + 1
    codes = np.fromiter((size - 1 if chr(c).isalpha() else GAP for c in range(0x110000)), np.int32, 0x110000)
    codes[[ord(c) for c in letters]] = np.arange(FIRST, FIRST + len(letters))
    return codes, size, [Automaton(symbols(text, codes), size) for _, text in model]


def symbols(text: str, codes: np.ndarray) -> np.ndarray:
    found = codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = found == GAP
    return found[~(gap & np.concatenate([[True], gap[:-1]]))] if len(found) else found


class Stretches:
    """Stretches of texts side by side, the longest first, with their owners; ``before`` is the place of each one's predecessor."""

    def __init__(self, texts: list[np.ndarray]):
        rows = [(k, a, t[a : a + STRETCH]) for k, t in enumerate(texts) for a in range(0, len(t), STRETCH)]
        rows.sort(key=lambda r: -len(r[2]))
        place = {(k, a): n for n, (k, a, _) in enumerate(rows)}
        self.owners = np.array([k for k, _, _ in rows])
        self.lengths = np.array([len(p) for _, _, p in rows])
        self.before = np.array([place.get((k, a - STRETCH), -1) for k, a, _ in rows])
        self.last = np.array([(k, a + STRETCH) not in place for k, a, _ in rows])
        grid = np.zeros((len(rows), self.lengths[0]), np.int32)
        for row, (_, _, p) in zip(grid, rows, strict=True):
            row[: len(p)] = p
        self.grid = np.ascontiguousarray(grid.T)

    def run(self, table: Automaton, symbols: np.ndarray, some: np.ndarray, start: np.ndarray, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """States and ended phrases of some stretches, after ``SETTLED`` symbols and at the end; they start in the given states.

        ``symbols`` is the grid in the automaton's own symbols.
        """
        lengths = self.lengths[some]
        at, ended = start.copy(), np.zeros(len(some), np.int64)
        grid = symbols if len(some) == len(self.lengths) else symbols[:, some]
        open_rows = (lengths[None, :] > np.arange(lengths[0])[:, None]).sum(axis=1).tolist()
        for j, n in enumerate(open_rows[:end]):
            if j == SETTLED:
                yield at.copy(), ended.copy()
            step = table.step(at[:n], grid[j, :n])
            ended[:n] += step & 3
            at[:n] = step >> 2
        if len(open_rows) <= SETTLED:
            yield at.copy(), ended.copy()
        yield at, ended


def phrases(texts: list[np.ndarray], tables: list[Automaton]) -> np.ndarray:
    """Phrases that each text (as symbols) needs in each language."""
    out = np.zeros((len(texts), len(tables)), np.int64)
    if not any(len(t) for t in texts):
        return out
    rows = Stretches(texts)
    every = np.arange(len(rows.lengths))
    for j, table in enumerate(tables):
        grid = table.local[rows.grid]
        (early, early_ended), (at, ended) = rows.run(table, grid, every, np.zeros(len(every), np.int32))
        start = np.zeros(len(every), np.int32)
        # Stretches whose predecessor ended in another state than they were started in.
        while len(wrong := np.flatnonzero((rows.before >= 0) & (at[rows.before] != start))):
            start[wrong] = at[rows.before[wrong]]
            *_, (now, n) = rows.run(table, grid, wrong, start[wrong], SETTLED)
            same = now == early[wrong]
            ended[wrong[same]] += n[same] - early_ended[wrong[same]]
            early_ended[wrong[same]] = n[same]
            if len(rest := wrong[~same]):
                (early[rest], early_ended[rest]), (at[rest], ended[rest]) = rows.run(table, grid, rest, start[rest])
        np.add.at(out[:, j], rows.owners, ended + ((at > 0) & rows.last))
    return out


def judge(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Language and margin of each text: one minus the phrases of the best over those of the second best."""
    codes, size, tables = prepared(model)
    read = [symbols(t, codes) if isinstance(t, str) else np.zeros(0, np.int32) for t in texts]
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [k for k, s in enumerate(read) if tables and (s != GAP).any()]
    counts = phrases([read[k] for k in known], tables)
    for k, row in zip(known, counts, strict=True):
        best = int(row.argmin())
        rest = np.delete(row, best)
        langs[k], scores[k] = model[best][0], float(1 - row[best] / rest.min()) if len(rest) else 1.0
    return langs, scores


def stretches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part are parsed together in bounded memory."""
    lengths = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    groups = np.cumsum(lengths) // TOGETHER
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; learned from ``docs`` itself unless a model is given."""
    model = learn(docs) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in stretches(b)):
            langs, scores = judge(part.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with a language: those that ``identify`` calls ``und`` go. One pass; all columns pass through."""
    model = learn(docs) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in stretches(b)):
            langs, _ = judge(part.column("text").to_pylist(), model)
            yield part.filter(pa.array([x != UNKNOWN for x in langs]))

    return docs.mapInArrow(run, docs.schema)
