"""Packing token sequences by minimum bin slack: bitset subset-sum over the histogram of remaining lengths."""

from __future__ import annotations

import functools
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, gapless, map_rows, read, scratch, small

#: Fixed value: how byte-level vocabularies of this kind split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space in a row from which a text goes to the tokenizers library: the other's pattern search would overflow its stack.
LONG_SPACE = 4000
_SPACES, _TWO = re.compile(r"\s{%d}" % LONG_SPACE), re.compile(r"\s\s")


class ByteTokenizer:
    """Ids of a byte-level BPE file as the tokenizers library gives them, without special tokens added.

    The file's merges run in tiktoken, which is several times faster. That takes a file whose ids follow its merges'
    order and which splits text by SPLIT alone; other files, texts that hold a special token's string and texts with
    LONG_SPACE white space characters in a row go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        if _ranked(spec):
            import tiktoken

            chars = _byte_chars()
            ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @functools.cached_property
    def slow(self):
        """The library's own tokenizer, loaded if a text needs it: a worker rarely keeps both."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> list[int]:
        if self.fast and not any(s in text for s in self.special) and not _long_space(text):
            return self.fast(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def _long_space(text: str) -> bool:
    """LONG_SPACE white space characters in a row; any such run covers two characters in turn of every (LONG_SPACE / 2)-th."""
    return len(text) >= LONG_SPACE and bool(_TWO.search(text[:: LONG_SPACE // 2])) and bool(_SPACES.search(text))


def _ranked(spec: dict) -> bool:
    """The file is plain byte-level BPE split by SPLIT, and a merge's result has the higher id the later the merge."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    return bool(merged) and merged[0] >= 256 and all(x < y for x, y in zip(merged, merged[1:]))


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer a worker process and file."""
    return ByteTokenizer(path)


class Plan:
    """Where the k-th piece of each length below the capacity goes.

    uses[length]: (first k, pieces a window, first sequence, offset) of the windows that take the length;
    slack: (first stream position, tokens, first sequence, offset) of the room that those windows leave;
    stream[length]: (first k, stream position) of the pieces that are laid end to end and cut: they fill the room, then
    windows of their own.
    """

    def __init__(self, capacity: int):
        self.capacity, self.sequences, self.pending, self.total = capacity, 0, 0, 0
        self.uses: dict[int, list[tuple[int, int, int, int]]] = {}
        self.slack: list[tuple[int, int, int, int]] = []
        self.stream: dict[int, tuple[int, int]] = {}

    @property
    def windows(self) -> int:
        """All sequences of the plan."""
        full, rest = divmod(self.total - self.pending, self.capacity)
        return self.sequences + full + rest.bit_count()

    def place(self, length: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, position): position is -1, or where a streamed piece begins."""
        rows = np.array(self.uses.get(length) or [(0, 1, -1, 0)], np.int64)
        at = np.searchsorted(rows[:, 0], k, side="right") - 1
        first, each, seq, off = rows[at].T
        q = k - first
        seq, off = seq + q // each, off + (q % each) * length
        pos = np.full(len(k), -1, np.int64)
        if length in self.stream:
            start, base = self.stream[length]
            pos = np.where(k >= start, base + (k - start) * length, -1)
        return seq, off, pos

    def cuts(self, begin: int, length: int) -> list[tuple[int, int, int, int]]:
        """A streamed piece's cuts as (skip, length, sequence, offset)."""
        out, p = [], begin
        while p < begin + length:
            seq, off, room = self._window(p)
            n = min(room, begin + length - p)
            out.append((p - begin, n, seq, off))
            p += n
        return out

    def _window(self, p: int) -> tuple[int, int, int]:
        """(sequence, offset, room) of a stream position: slack first, then full windows; the last tokens fill windows of falling powers of two."""
        if p < self.pending:
            start, size, seq, off = self.slack[bisect_right(self.slack, (p, self.capacity)) - 1]
            at = (p - start) % size
            return seq + (p - start) // size, off + at, size - at
        p -= self.pending
        full, rest = divmod(self.total - self.pending, self.capacity)
        if p < full * self.capacity:
            return self.sequences + p // self.capacity, p % self.capacity, self.capacity - p % self.capacity
        at, n = full * self.capacity, 0
        while True:
            size = 1 << (rest.bit_length() - 1)
            if p < at + size:
                return self.sequences + full + n, p - at, size - (p - at)
            at, n, rest = at + size, n + 1, rest - size


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> Plan:
    """Fills window after window around the longest length left.

    For each, a subset-sum bitset over the remaining multiset (counts in binary) finds the fill closest to capacity
    and backtracking gives its counts; the window is used as often as they last, and as long as the tokens left can
    still fill the slack that windows leave. What is left then, the shortest lengths, is laid end to end and cut: first
    into that slack. There are at most some rounds a length, whatever the corpus holds.
    """
    plan, left, taken = Plan(capacity), {n: c for n, c in counts.items() if c > 0 and 0 < n < capacity}, dict.fromkeys(counts, 0)
    tokens = sum(n * c for n, c in left.items())  # in pieces without a window
    while left:
        seed = max(left)
        left[seed] -= 1
        fill = _subset(left, capacity - seed)
        left[seed] += 1
        fill[seed] = fill.get(seed, 0) + 1
        # a window takes its fill from the tokens and leaves the rest of the capacity to be filled by them
        times = min(min(left[n] // m for n, m in fill.items()), (tokens - plan.pending) // capacity)
        if times <= 0:
            break
        offset = 0
        for n in sorted(fill, reverse=True):
            plan.uses.setdefault(n, []).append((taken[n], fill[n], plan.sequences, offset))
            offset += n * fill[n]
            taken[n] += fill[n] * times
            left[n] -= fill[n] * times
            if not left[n]:
                del left[n]
        tokens -= offset * times
        if offset < capacity:
            plan.slack.append((plan.pending, capacity - offset, plan.sequences, offset))
            plan.pending += (capacity - offset) * times
        plan.sequences += times
    for n in sorted(left, reverse=True):
        plan.stream[n] = (taken[n], plan.total)
        plan.total += n * left[n]
    return plan


def _subset(left: dict[int, int], target: int) -> dict[int, int]:
    """Counts of lengths whose sum comes closest to target from below; longer lengths are preferred."""
    mask, reach, steps = (1 << (target + 1)) - 1, 1, []
    for n in sorted(x for x in left if x <= target and left[x]):
        c, k = min(left[n], target // n), 1
        while c:
            k = min(k, c)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            c, k = c - k, 2 * k
    target = reach.bit_length() - 1
    out: dict[int, int] = {}
    for n, k, before in reversed(steps):
        if n * k <= target and before >> (target - n * k) & 1:
            out[n] = out.get(n, 0) + k
            target -= n * k
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, tag: str = "packing") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of docs(doc_id, text, ...).

    A document is its token ids and end_id; a null or empty text is end_id alone. Whole windows are cut off first;
    the remainders, fewer than `capacity` lengths, go through minimum_bin_slack on the driver as a histogram. No
    sequence has padding: pieces that the plan cuts anew fill what others leave, and the tail fills windows of powers
    of two. Only their documents are tokenised twice. capacity is a power of two. A very long text gives as many whole
    windows as it fills; one of LONG_SPACE white space characters in a row takes the slower of two equal ways to its
    ids. Pieces of one length are equal to the plan: which of them goes where follows the order of partitions. Repeated
    rows keep their pieces each; other columns are not used; an empty table gives none.
    """

    def ids_of(text: str | None, tok: ByteTokenizer) -> np.ndarray:
        return np.array([*tok(text or ""), end_id], np.uint32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        from pyspark import TaskContext

        tok, part, seen = tokenizer(vocabulary), TaskContext.get().partitionId(), {}
        for b in small(batches, 1000):
            rows = []
            for doc, h, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1)):
                ids = ids_of(text.as_py(), tok)
                n = len(ids)
                raw = memoryview(ids.tobytes())
                for s in range(0, n, capacity):
                    size = min(capacity, n - s)
                    k = seen.get(size, 0)
                    seen[size] = k + 1
                    rows.append((doc, h, s, size, zlib.crc32(raw[4 * s : 4 * (s + size)]), n, part, k))
            names = ("doc_id", "h", "start", "length", "ids_crc32", "doc_tokens", "part", "local")
            yield dict(zip(names, zip(*rows))) if rows else dict.fromkeys(names, [])

    text = documents(docs).withColumn("h", F.xxhash64("text"))
    pieces = scratch(map_rows(text, "doc_id long, h long, start long, length int, ids_crc32 long, doc_tokens long, part int, local long", cut), tag)
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = minimum_bin_slack(histogram, capacity)
    whole = plan.windows
    shared = pieces.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity, not by the corpus

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        plan = shared.value
        for b in batches:
            x = {n: b.column(i).to_numpy() if n in ("length", "k") else b.column(i) for i, n in enumerate(b.schema.names)}
            seq, off, pos = np.full(b.num_rows, -1, np.int64), np.zeros(b.num_rows, np.int64), np.full(b.num_rows, -1, np.int64)
            for n in np.unique(x["length"]):
                at = np.flatnonzero(x["length"] == n)
                k = x["k"][at]
                seq[at], off[at], pos[at] = (whole + k, 0, -1) if n == capacity else plan.place(int(n), k)
            yield {c: x[c] for c in ("doc_id", "h", "start", "length", "ids_crc32", "doc_tokens")} | {"sequence_id": seq, "offset": off, "pos": pos}

    ranked = gapless(pieces, "part", "length", "local", "k").select("doc_id", "h", "start", "length", "ids_crc32", "doc_tokens", F.col("k").cast("long").alias("k"))
    seated = scratch(map_rows(ranked, "doc_id long, h long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, pos long", seat), tag)
    result = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    done = seated.where("pos < 0").select(result)
    streamed = scratch(seated.where("pos >= 0"), tag)  # of its own, so that its real size decides how texts are found
    if streamed.isEmpty():
        return done
    key = F.coalesce("doc_id", F.lit(-(2**63))).alias("key")  # a null id is an id here
    streamed = streamed.withColumn("key", key)
    texts = text.select(key, "h", "text").join(streamed.select("key", "h"), ["key", "h"], "left_semi").dropDuplicates(["key", "h"])

    def recut(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        tok, plan = tokenizer(vocabulary), shared.value
        for b in small(batches, 1000):
            rows = []
            for doc, start, length, n, pos, text in zip(*(b.column(i).to_pylist() for i in range(6))):
                ids = ids_of(text, tok)[start : start + length]
                for skip, size, seq, off in plan.cuts(pos, length):
                    rows.append((doc, start + skip, size, zlib.crc32(ids[skip : skip + size].tobytes()), n, seq, off))
            yield dict(zip(result, zip(*rows))) if rows else dict.fromkeys(result, [])

    again = streamed.join(texts, ["key", "h"]).select("doc_id", "start", "length", "doc_tokens", "pos", "text")
    return done.unionByName(map_rows(again, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", recut))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary_path())
