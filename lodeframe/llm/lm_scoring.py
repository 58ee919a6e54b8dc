"""Stupid-backoff scores of documents under bigram counts of the whole corpus, the document itself left out.

A word w after v scores log((c(v w) - own) / c(v .)) if other documents have v w, else log(0.4 c(w) / n); c counts
over all documents, own is the document's own count of v w, c(v .) the count of v before a word, n all words. A
document's first word follows a start mark. The score of a document is the sum over its words.

Count tables are partitioned by hash. Bigrams are exploded per block of documents and sent to the partition of
their context (of the pair, for hot contexts), where the count table of the partition is made from all that arrives
and joined to the bigrams in one sort. Words that back off go on to the partition of the word's own count. Sums per
document come back by block. Messages are packed arrays, as rows of their own would take several times the input on
disk: for each distinct bigram of a block its hashes once, and two bytes for each document.

Hot words and hot bigrams, those over 1 / HOT of all words, have counts that every task knows (at most 2 HOT words
and HOT bigrams, whatever the corpus): a hot bigram is scored where it is read, and a hot word that backs off where
that is found, so no partition gets more than 1 / HOT of all words for one key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import Words, cut, text_blocks, utf8

BACKOFF = 0.4
START = np.uint64(0x53544152542D4D)
HOT = 1000
#: Words of one block of documents, and of one partition of the counts (a document over a mebibyte is a block of its own).
BLOCK_WORDS, BUCKET_WORDS = 800_000, 1_000_000
#: Documents of a block, and sums that a task holds before it sends them on.
MOST_DOCS, MOST_SUMS = 50_000, 4_000_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """Words of some documents: hashes, and the document of each. Hashes keep 56 bits, so that messages hold seven
    bytes for each."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], docs: int):
        self.hashes = np.concatenate([p[0] for p in parts]) >> np.uint64(8)
        self.text = np.concatenate([p[1] for p in parts])
        self.sizes = np.bincount(self.text, minlength=docs)

    def contexts(self) -> np.ndarray:
        before = np.append(START, self.hashes[:-1])[: len(self.hashes)]
        first = np.append(True, self.text[1:] != self.text[:-1])[: len(self.hashes)]
        before[first] = START
        return before


def _blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[tuple[int, pa.Array, Block]]:
    """Numbered blocks of documents of one task: (number, ids, words)."""
    number = 0
    for batch in batches:
        for begin in range(0, batch.num_rows, MOST_DOCS):
            some = batch.slice(begin, MOST_DOCS)
            texts, parts, low, held = utf8(some.column(1)), [], 0, 0
            for a, b in text_blocks(texts):
                words = Words(texts[a:b])
                if parts and held + len(words.hashes) > block_words:
                    yield number, some.column(0)[low:a], Block(parts, a - low)
                    number, parts, low, held = number + 1, [], a, 0
                parts.append((words.hashes, words.text + (a - low)))
                held += len(words.hashes)
            if parts:
                yield number, some.column(0)[low:], Block(parts, len(texts) - low)
                number += 1


def word_counts(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, before): counts of each word hash, and of it before another word or (the start mark) a text."""

    def run(batches):
        for _, _, words in _blocks(batches, block_words):
            seen, n = np.unique(words.hashes, return_counts=True)
            context, before = np.unique(words.contexts(), return_counts=True)
            both = np.union1d(seen, context)
            columns = []
            for keys, values in ((seen, n), (context, before)):
                full = np.zeros(len(both), dtype=np.int64)
                full[np.searchsorted(both, keys)] = values
                columns.append(pa.array(full))
            yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), *columns], ["word", "n", "before"])

    return docs.mapInArrow(run, "word long, n long, before long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("before").alias("before"))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another; of unsigned 64-bit ones (hashes) the low seven bytes."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(-1, 8)[:, :7].tobytes() if a.dtype == np.uint64 else a.tobytes()
        out += [len(a).to_bytes(8, "little"), raw]
    return b"".join(out)


def _unpack(data, *types: str) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        n = int.from_bytes(data[at : at + 8], "little")
        at += 8
        if t == "<u8":
            a = np.zeros((n, 8), np.uint8)
            a[:, :7] = np.frombuffer(data, np.uint8, 7 * n, at).reshape(n, 7)
            out.append(a.view("<u8").ravel())
            at += 7 * n
        else:
            out.append(np.frombuffer(data, t, n, at))
            at += out[-1].nbytes
    return out


def _group(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal sorted keys starts."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spread(h: np.ndarray, n: int) -> np.ndarray:
    return ((h * _SPREAD >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


# messages: (kind, to, block, data). kind 0: bigrams for count partition `to`; 1: words that backed off, for word
# partition `to`; 2: sums for the documents of `block`; 3: ids and sizes of the documents of `block`; 4: word counts
_MESSAGE = "kind byte, to long, block long, data binary"


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int8(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["kind", "to", "block", "data"])


class Hot(NamedTuple):
    """Words that are hot, sorted, with their counts and their counts before a word, and hot bigrams, sorted."""

    words: np.ndarray
    n: np.ndarray
    before: np.ndarray
    first: np.ndarray
    second: np.ndarray
    pairs: np.ndarray
    total: int

    def find(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is hot, and where."""
        if not len(self.words):
            return np.zeros(len(word), bool), np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return self.words[at] == word, at

    def back_off(self, n: np.ndarray) -> np.ndarray:
        return np.log(BACKOFF * n / max(self.total, 1))


def hot_counts(docs: DataFrame, counts: DataFrame, total: int, hot: int = HOT, block_words: int = BLOCK_WORDS) -> Hot:
    """Hot words of the counts, and the hot bigrams: both words of one are hot, so at most (2 hot) ** 2 are counted."""
    heavy = counts.where((F.col("before") > F.lit(total / hot)) | (F.col("n") > F.lit(total / hot))).toPandas()  # at most 2 hot rows
    words = heavy["word"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    none = np.zeros(0, np.int64)
    found = Hot(words[order], heavy["n"].to_numpy(dtype=np.int64)[order], heavy["before"].to_numpy(dtype=np.int64)[order], none, none, none, total)

    def run(batches):
        for _, _, block in _blocks(batches, block_words):
            (one, v), (two, w) = found.find(block.contexts()), found.find(block.hashes)
            seen, n = np.unique((v << 32 | w)[one & two], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

    if not len(words):
        return found
    pairs = docs.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(total / hot)).orderBy("pair").toPandas()  # at most hot rows
    pair = pairs["pair"].to_numpy(dtype=np.int64)
    return found._replace(first=pair >> 32, second=pair & 0xFFFFFFFF, pairs=pairs["n"].to_numpy(dtype=np.int64))


def _hot_scores(hot: Hot, v: np.ndarray, w: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Which bigrams are hot, and each document's sum of the scores of those."""
    total = np.zeros(docs)
    if not len(hot.pairs):
        return np.zeros(len(v), bool), total
    (one, i), (two, j) = hot.find(v), hot.find(w)
    keys, key = hot.first << 32 | hot.second, i << 32 | j
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    known = one & two & (keys[at] == key)
    seen, own = np.unique(doc[known].astype(np.int64) * len(keys) + at[known], return_counts=True)
    of, at = np.divmod(seen, len(keys))
    others = hot.pairs[at] - own
    value = np.where(others > 0, np.log(np.maximum(others, 1) / hot.before[hot.first[at]]), hot.back_off(hot.n[hot.second[at]]))
    return known, np.bincount(of, weights=value * own, minlength=docs)


def _explode(hot: Hot, buckets: int, block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, ids, words in _blocks(batches, block_words):
            block = task << 24 | number
            v, w, doc = words.contexts(), words.hashes, words.text.astype(np.uint16)
            known, total = _hot_scores(hot, v, w, doc, len(ids))
            named = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            plain = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield _messages([(3, block, block, _pack(plain, words.sizes.astype(np.int64), named.astype(np.int64), total))])
            v, w, doc = v[~known], w[~known], doc[~known]
            to = _spread(np.where(hot.find(v)[0], (v * _SPREAD ^ w) * np.uint64(0xD6E8FEB86659FD93), v), buckets)
            order = np.lexsort((doc, w, v, to))
            to, v, w, doc = to[order], v[order], w[order], doc[order]
            start = _group(v, w) if len(v) else np.zeros(0, np.int64)
            edges = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else [], len(to)).astype(np.int64)
            out = []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                mine = start[np.searchsorted(start, low) : np.searchsorted(start, high)]
                counts = np.diff(np.append(mine, high)).astype(np.uint32)
                contexts = _group(v[mine])
                runs = np.diff(np.append(contexts, len(mine))).astype(np.uint32)
                out.append((0, int(to[low]), block, _pack(v[mine][contexts], runs, w[mine], counts, doc[low:high])))
            yield _messages(out)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[int, int, bytes]]]]:
    """Rows sorted by `to`: (kind, to, [(kind, block, data)]) of each."""
    to, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            now = batch.column(1)[i].as_py()
            if now != to and held:
                yield held[0][0], to, held
                held = []
            to = now
            held.append((batch.column(0)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))
    if held:
        yield held[0][0], to, held


class _Sums:
    """Sums for documents, held by block until there are many."""

    def __init__(self):
        self.held: dict[int, np.ndarray] = {}
        self.size = 0

    def add(self, row: np.ndarray, doc: np.ndarray, value: np.ndarray, blocks: list[int]) -> None:
        """value for document doc of blocks[row]; row rises."""
        edges = np.append(_group(row), len(row)) if len(row) else np.zeros(1, int)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            block, new = blocks[int(row[a])], np.bincount(doc[a:b], weights=value[a:b])
            old = self.held.get(block, new[:0])
            self.size += max(0, len(new) - len(old))
            if len(old) < len(new):
                old, new = new, old
            old[: len(new)] += new
            self.held[block] = old

    def messages(self, most: int = 0) -> list[tuple[int, int, int, bytes]]:
        if self.size <= most:
            return []
        out = [(2, block, block, _pack(total)) for block, total in self.held.items()]
        self.held, self.size = {}, 0
        return out


def _score(hot: Hot, words_to: int):
    """Count partitions: scores of bigrams that other documents have, and messages for those that back off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for kind, _, rows in _grouped(batches):
            if kind != 0:
                yield _messages([(k, b, b, d) for k, b, d in rows])
                continue
            blocks, parts = [r[1] for r in rows], []
            for n, (_, _, data) in enumerate(rows):
                contexts, runs, w, counts, doc = _unpack(data, "<u8", "<u4", "<u8", "<u4", "<u2")
                parts.append((np.repeat(contexts, runs), w, counts, np.full(len(w), n, np.int32), doc))
            v, w, counts, row = (np.concatenate([p[i] for p in parts]) for i in range(4))
            doc = np.concatenate([p[4] for p in parts])
            begin = np.cumsum(counts, dtype=np.int64) - counts
            # the count tables of this partition, bigrams and contexts, joined to the bigrams asked for
            order = np.lexsort((w, v))
            pairs = _group(v[order], w[order])
            of_pair = np.zeros(len(order), dtype=np.int64)
            of_pair[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), pairs), np.diff(np.append(pairs, len(order))))
            contexts = _group(v[order])
            of_context = np.zeros(len(order), dtype=np.int64)
            of_context[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), contexts), np.diff(np.append(contexts, len(order))))
            is_hot, at = hot.find(v)
            of_context[is_hot] = hot.before[at[is_hot]]
            # one entry for each document of a bigram; its documents stand in order
            entry = np.repeat(np.arange(len(counts)), counts)
            own_at = _group(entry, doc)
            entry, doc = entry[own_at], doc[own_at]
            own = np.diff(np.append(own_at, int(begin[-1] + counts[-1])))
            others = of_pair[entry] - own
            seen, (plain, at) = others > 0, hot.find(w[entry])
            value = np.log(np.maximum(others, 1) / of_context[entry])
            value[~seen] = np.log(BACKOFF / max(hot.total, 1))
            now = ~seen & plain
            if now.any():
                value[now] = hot.back_off(hot.n[at[now]])
            sums.add(row[entry], doc, value * own, blocks)
            out = sums.messages(MOST_SUMS)
            # backing off, words that are not hot: one message for each word partition, of all blocks together
            left = ~seen & ~plain
            e, d, k = entry[left], doc[left], own[left]
            word, r = w[e], row[e]
            to = _spread(word * _SPREAD, words_to)
            order = np.lexsort((d, r, word, to))
            to, r, word, d, k = to[order], r[order], word[order], d[order], k[order]
            edges = np.append(_group(to), len(to)) if len(to) else np.zeros(1, int)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                starts = _group(word[a:b])
                known, at = np.unique(r[a:b], return_inverse=True)
                runs = np.diff(np.append(starts, b - a)).astype(np.uint32)
                out.append((1, -1 - int(to[a]), 0, _pack(word[a:b][starts], runs, d[a:b], k[a:b].astype(np.uint32), at.astype(np.uint32), np.array([blocks[i] for i in known], np.int64))))
            yield _messages(out)
        yield _messages(sums.messages())

    return run


def _back_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word partitions: log counts of the words that backed off, summed for their documents."""
    sums = _Sums()
    for kind, to, rows in _grouped(batches):
        if kind not in (1, 4) or to >= 0:
            yield _messages([(k, b, b, d) for k, b, d in rows])
            continue
        counted = [_unpack(d, "<u8", "<i8") for k, _, d in rows if k == 4]
        word = np.concatenate([c[0] for c in counted]) if counted else np.zeros(0, np.uint64)
        count = np.concatenate([c[1] for c in counted]) if counted else np.zeros(0, np.int64)
        order = np.argsort(word)
        word, count = word[order], count[order]
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0))]
        for k, _, data in rows:
            if k == 1:
                asked, runs, doc, own, at, blocks = _unpack(data, "<u8", "<u4", "<u2", "<u4", "<u4", "<i8")
                logs = np.log(count[np.searchsorted(word, asked)])
                parts.append((blocks[at], doc, np.repeat(logs, runs) * own))
        block, doc, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(block, kind="stable")
        every, row = np.unique(block[order], return_inverse=True)
        sums.add(row, doc[order], value[order], every.tolist())
        yield _messages(sums.messages(MOST_SUMS))
    yield _messages(sums.messages())


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, rows in _grouped(batches):
        (ids, sizes, known, total), = [_unpack(d, "<i8", "<i8", "<i8", "<f8") for k, _, d in rows if k == 3]
        total = total.copy()
        for k, _, data in rows:
            if k == 2:
                more, = _unpack(data, "<f8")
                total[: len(more)] += more
        missing = np.ones(len(ids), dtype=bool)
        missing[known] = False
        empty = sizes == 0
        mean = np.divide(total, sizes, out=np.zeros(len(ids)), where=~empty)
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=missing), pa.array(sizes), pa.array(total), pa.array(mean, mask=empty)], ["doc_id", "n_words", "log_score", "mean_log_score"])


def stupid_backoff(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_words: int = BUCKET_WORDS, block_words: int = BLOCK_WORDS, hot: int = HOT) -> DataFrame:
    """One row for each row of docs: (doc_id, n_words, log_score, mean_log_score), natural logarithms.

    Words are [^\\x20\\x09-\\x0D]+ as they stand. Rows without words (null, empty or blank texts) have score 0 and
    a null mean. Repeated rows and equal texts count as documents of their own, so each is seen by the others. A
    null id keeps its row. An empty table gives an empty result.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    counts = cut(word_counts(base, block_words), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = hot_counts(base, counts, total, hot, block_words)
    buckets, words_to = max(1, -(-total // bucket_words)), max(1, -(-total // (4 * bucket_words)))

    def shards(batches):
        for batch in batches:
            word, n = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            to = _spread(word * _SPREAD, words_to)
            order = np.argsort(to, kind="stable")
            to, word, n = to[order], word[order], n[order]
            edges = np.append(_group(to), len(to)) if len(to) else np.zeros(1, int)
            yield _messages([(4, -1 - int(to[a]), 0, _pack(word[a:b], n[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("to").sortWithinPartitions("to", "kind")

    asked = base.mapInArrow(_explode(heavy, buckets, block_words), _MESSAGE)
    scored = dealt(asked.withColumn("to", F.when(F.col("kind") == 0, -1 - F.col("to")).otherwise(F.col("to")))).mapInArrow(_score(heavy, words_to), _MESSAGE)
    tables = counts.where("n > 0").select("word", "n").mapInArrow(shards, _MESSAGE)
    summed = dealt(scored.unionAll(tables)).mapInArrow(_back_off, _MESSAGE)
    return dealt(summed).mapInArrow(_by_document, "doc_id long, n_words long, log_score double, mean_log_score double")
