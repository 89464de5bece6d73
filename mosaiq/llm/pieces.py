"""SentencePiece encoding by suffix-array matching, and decoding.

The model is a BPE one: of all neighbouring symbols whose concatenation is a piece, the pair
with the best score merges first. The result is found without merging. The new words of a
batch are concatenated and indexed by a suffix array; a binary search of every piece gives the
range of its occurrences, and so all edges from a start to an end. Edges are sorted by the end's
place in its word and relaxed in that order: of the edges into an end exactly one continues the
encoding of the text before its start, the one whose piece BPE would not have merged across that
start. Whether it would is known from how the two pieces came about, whatever stands around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The mark that stands for a space.
MARK = "▁"
#: Encodings of words that a worker remembers; beyond, it forgets those that came least.
REMEMBERED = 300_000
#: Code points of new words that are indexed at once.
BATCH = 1 << 18
#: Characters of texts that are split into words at once.
PART = 1 << 20
#: Code points that are compared at once, and the largest number of one.
SPAN, _TOP = 4, (1 << 15) - 1
_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_BORDER = re.compile(f"[^{MARK}](?={MARK})|\n")


#: Bits of the sieve's places.
_SIEVE = 20


def _places(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * 0x9E3779B1 + y * 0x85EBCA77) >> 12 & ((1 << _SIEVE) - 1)


@dataclass
class Pieces:
    """The model's tables, in an order of symbols where single characters come first and then
    the pieces by the order in which they merge. ``left`` and ``right`` are the two symbols that
    a piece merges from (itself for single characters)."""

    texts: list[str]  # by symbol
    ids: np.ndarray  # the model's id by symbol
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray  # left * 2^32 + right, sorted
    merged: np.ndarray  # the symbol each pair gives
    sieve: np.ndarray  # marks the hashed places of all pairs
    by_id: list[bytes]  # UTF-8 of each id, for decoding
    byte_ids: list[int]  # id of each byte
    run_ids: list[int]  # id of each run of marks, by length

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        total = range(model.vocab_size())
        byte_ids, by_id, plain = [0] * 256, [b""] * len(total), []
        for i in total:
            text = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(text[3:-1], 16)] = i
                by_id[i] = bytes([int(text[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                by_id[i] = text.replace(MARK, " ").encode()
                plain.append((len(text) > 1, -model.get_score(i), i, text))
        # Runs of marks have one score for all and are encoded apart.
        plain = [x for x in sorted(plain) if len(x[3]) == 1 or x[3].strip(MARK)]
        symbol = {x[3]: k for k, x in enumerate(plain)}
        left, right, usable = np.arange(len(plain)), np.arange(len(plain)), []
        names = [x[3] for x in plain]
        for k, text in enumerate(names):
            if len(text) > 1:
                parts = _merged([symbol.get(c, -1) for c in text], names, symbol, k)
                if len(parts) == 2:
                    left[k], right[k] = parts
                    usable.append(k)
        usable = np.array(usable, dtype=np.int64)
        keys = left[usable] << 32 | right[usable]
        order = np.argsort(keys)
        runs = [0] + [model.piece_to_id(MARK * k) for k in range(1, 17)]
        texts, ids = [x[3] for x in plain], np.array([x[2] for x in plain])
        sieve = np.zeros(1 << _SIEVE, dtype=bool)
        sieve[_places(left[usable], right[usable])] = True
        return cls(texts, ids, left, right, keys[order], usable[order], sieve, by_id, byte_ids, runs)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For neighbouring symbols a and b: whether BPE leaves the border between them. Both are
        taken apart again, the later merge first; the border falls if two symbols meet at it
        that merge before the piece of either side came about."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        rest = np.flatnonzero((a >= 0) & (b >= 0))
        while len(rest):
            x, y, most = a[rest], b[rest], limit[rest]
            crossed = self.sieve[_places(x, y)]
            some = np.flatnonzero(crossed)
            keys = x[some] << 32 | y[some]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            crossed[some] = (self.pairs[at] == keys) & (self.merged[at] < most[some])
            out[rest[crossed]] = False
            rest, x, y = rest[~crossed], x[~crossed], y[~crossed]
            px, py = self.right[x], self.left[y]
            # The later of both goes first; if it is a single character, the other does.
            first = np.where(x > y, px != x, py == y)
            done = (px == x) & (py == y)
            limit[rest] = np.where(first, x, y + 1)
            a[rest], b[rest] = np.where(first, px, x), np.where(first, y, py)
            rest = rest[~done]
        return out


def _merged(parts: list[int], texts: list[str], symbol: dict[str, int], below: int) -> list[int]:
    """BPE by merging, of merges before ``below`` only."""
    while len(parts) > 1:
        best = min(((symbol.get(texts[a] + texts[b], below) if a >= 0 and b >= 0 else below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] >= below:
            break
        parts[best[1] : best[1] + 2] = [best[0]]
    return parts


def suffix_array(packed: np.ndarray, reach: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``reach`` code points, from the packed
    first four of each: ranks of twice as many follow from ranks of two suffixes."""
    order, k, n = np.argsort(packed, kind="stable"), SPAN, len(packed)
    key = packed
    while k < reach:
        first = np.r_[True, (s := key[order])[1:] != s[:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(first)
        key = rank << 32
        key[: max(n - k, 0)] |= rank[k:]  # the last k suffixes have none k places behind
        order, k = np.argsort(key, kind="stable"), 2 * k
    return order


def _packed(columns) -> np.ndarray:
    """``SPAN`` neighbouring code points' numbers in one, which compares as they do."""
    out = columns[0].astype(np.int64)
    for c in columns[1:]:
        out = out << 15 | c
    return out


def _bound(packed: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """Binary search, in the range of each: the first place whose packed code points are not below
    (``after``: are above) the wanted ones."""
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) >> 1
        have, want = packed[mid], wanted[open_]
        smaller = have <= want if after else have < want
        low[open_[smaller]] = mid[smaller] + 1
        high[open_[~smaller]] = mid[~smaller]
    return low


class Encoder:
    """Encodes texts with a memory of words. One for each worker."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.reach = 16
        known = [k for k, t in enumerate(pieces.texts) if len(t) == 1 or pieces.left[k] != k]
        known.sort(key=pieces.texts.__getitem__)
        texts = [pieces.texts[k] for k in known]
        self.known = np.array(known, dtype=np.int32)
        self.lengths = np.array([len(t) for t in texts], dtype=np.int32)
        if self.lengths.max() > self.reach:
            raise ValueError("a piece is longer than the suffix array compares")
        # Code points by number: 0 ends a word, 1 is none of any piece.
        alphabet = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4"))
        if len(alphabet) >= _TOP:
            raise ValueError("the pieces have too many code points to be packed")
        self.number = np.ones(0x110000, dtype=np.int16)
        self.number[alphabet] = np.arange(2, len(alphabet) + 2)
        codes = np.zeros((len(texts), self.reach), dtype=np.int64)
        for row, t in enumerate(texts):
            codes[row, : len(t)] = self.number[np.frombuffer(t.encode("utf-32-le"), dtype="<u4")]
        # The least and the largest packed code points that agree with each part of a piece.
        self.least = [_packed(codes[:, k : k + SPAN].T) for k in range(0, self.reach, SPAN)]
        self.most = [_packed(np.where(c > 0, c, _TOP).T) for c in (codes[:, k : k + SPAN] for k in range(0, self.reach, SPAN))]
        # The memory: the row of each word, how often it came, and where its ids stand among all.
        self.row: dict[str, int] = {"\n": 0}
        self.uses = np.zeros(0, dtype=np.int64)
        self.at, self.count = [np.zeros(1, dtype=np.int64)], [np.ones(1, dtype=np.int64)]
        self.ids = [np.array([pieces.byte_ids[10]], dtype=np.int32)]
        self.size = 1

    def _forget(self) -> None:
        """Keep the words that came most, half as many as the memory may hold, and none that came once."""
        at, count, ids = self._known()
        uses = np.r_[self.uses, np.zeros(len(self.row) - len(self.uses), dtype=np.int64)]
        keep = np.zeros(len(uses), dtype=bool)
        keep[np.argsort(-uses, kind="stable")[: REMEMBERED // 2]] = True
        keep &= uses > 1
        keep[0] = True
        words = list(compress(self.row, keep))
        at, count = at[keep], count[keep]
        ends = np.cumsum(count)
        self.ids = [ids[np.repeat(at - (ends - count), count) + np.arange(ends[-1])]]
        self.row = {w: k for k, w in enumerate(words)}
        self.at, self.count, self.size = [ends - count], [count], int(ends[-1])
        self.uses = uses[keep] // 2

    def _remember(self, words: list[str], at: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        for k, w in enumerate(words, len(self.row)):
            self.row[w] = k
        self.at.append(at + self.size)
        self.count.append(count)
        self.ids.append(ids)
        self.size += len(ids)

    def _known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for name in ("at", "count", "ids"):
            parts = getattr(self, name)
            if len(parts) > 1:
                setattr(self, name, [np.concatenate(parts)])
        return self.at[0], self.count[0], self.ids[0]

    def learn(self, words: list[str]) -> None:
        """Encode new words (with at most one mark, at their start) and remember them."""
        start, size = 0, 0
        for k, w in enumerate(words):
            size += len(w) + 1
            if size >= BATCH or k == len(words) - 1:
                self._learn(words[start : k + 1])
                start, size = k + 1, 0

    def _learn(self, words: list[str]) -> None:
        # A 0 ends each word, and more of them the last.
        text = "\0".join(words) + "\0"
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        total = int(ends[-1]) + 1
        codes = np.zeros(total + self.reach, dtype=np.int64)
        codes[:total] = self.number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        codes[ends] = 0
        packed = _packed([codes[k : len(codes) - SPAN + 1 + k] for k in range(SPAN)])
        order = suffix_array(packed[:total], self.reach)
        # Every piece is searched by four code points at a time; those that occur go on.
        sorted_ = packed[order]
        low = np.searchsorted(sorted_, self.least[0], "left")
        high = np.searchsorted(sorted_, self.most[0], "right")
        for k in range(1, self.reach // SPAN):
            more = np.flatnonzero((self.lengths > SPAN * k) & (low < high))
            if len(more):
                sorted_ = packed[np.minimum(order + SPAN * k, len(packed) - 1)]
                a, b = low[more], high[more]
                low[more] = _bound(sorted_, a, b, self.least[k][more], False)
                high[more] = _bound(sorted_, a, b, self.most[k][more], True)
        count = high - low
        symbol, length = np.repeat(self.known, count), np.repeat(self.lengths, count)
        begin = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())].astype(np.int32)
        # Characters without a piece are edges of their own; nothing merges with them.
        single = np.zeros(total, dtype=bool)
        single[begin[length == 1]] = True
        odd = np.flatnonzero(~single & (codes[:total] > 0)).astype(np.int32)
        begin, length = np.r_[begin, odd], np.r_[length, np.ones(len(odd), dtype=np.int32)]
        symbol = np.r_[symbol, np.full(len(odd), -1, dtype=np.int32)]
        owner_start = np.repeat(starts.astype(np.int32), sizes + 1)
        inside = begin - owner_start[begin]
        place = inside + length
        by = np.argsort(place.astype(np.uint16) if sizes.max() < 1 << 16 else place, kind="stable")
        begin, length, symbol, place, first = begin[by], length[by], symbol[by], place[by], inside[by] == 0
        last = np.full(total + 1, -2, dtype=np.int32)  # the symbol that ends at each place
        back = np.zeros(total + 1, dtype=np.int32)
        bounds = np.searchsorted(place, np.arange(1, sizes.max() + 2)).tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            s, y = begin[a:b], symbol[a:b]
            x = last[s]
            ok = first[a:b].copy()
            rest = np.flatnonzero(~ok & (x >= 0) & (y >= 0))
            ok[rest] = self.p.apart(x[rest], y[rest])
            # Characters without a piece stand apart from what is before and after them.
            ok |= ((y < 0) | (x == -1)) & (x > -2) & ~first[a:b]
            n, s, y = length[a:b][ok], s[ok], y[ok]
            last[s + n] = y
            back[s + n] = n
        # Walk back from all ends at once.
        at, bottom = ends.copy(), starts
        cut = np.zeros(total + 1, dtype=bool)
        while len(at):
            cut[at] = True
            at = at - back[at]
            more = at > bottom
            at, bottom = at[more], bottom[more]
        cuts = np.flatnonzero(cut)
        found = last[cuts]
        ids = np.where(found >= 0, self.p.ids[found], -1).astype(np.int32)
        bounds = np.searchsorted(cuts, np.r_[starts, ends[-1] + 1], side="right")
        at, count = bounds[:-1].copy(), np.diff(bounds)
        extra, size = [ids], len(ids)
        for k in np.unique(np.searchsorted(ends, cuts[found < 0])).tolist():
            w, row = words[k], []
            for e, y in zip((cuts[bounds[k] : bounds[k + 1]] - starts[k]).tolist(), ids[bounds[k] : bounds[k + 1]].tolist(), strict=True):
                row += [y] if y >= 0 else [self.p.byte_ids[x] for x in w[e - 1].encode("utf-8", "surrogatepass")]
            extra.append(np.array(row, dtype=np.int32))
            at[k], count[k] = size, len(row)
            size += len(row)
        self._remember(words, at, count, np.concatenate(extra))

    def _run(self, k: int) -> list[int]:
        """A run of marks: the longest pieces from the left."""
        return [self.p.run_ids[16]] * (k // 16) + ([self.p.run_ids[k % 16]] if k % 16 else [])

    def _learn_marked(self, marked: list[str]) -> None:
        """Words behind a run of marks, and such runs alone."""
        at, count, ids = self._known()
        rows = []
        for w in marked:
            bare = w.lstrip(MARK)
            run, known = len(w) - len(bare), []
            if bare:
                k = self.row[MARK + bare]
                known = ids[at[k] : at[k] + count[k]].tolist()
                # The word's own mark belongs to the run if nothing merged with it.
                run, known = (run, known[1:]) if known[0] == self.p.run_ids[1] else (run - 1, known)
            rows.append(self._run(run) + known)
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self._remember(marked, np.cumsum(sizes) - sizes, sizes, np.fromiter(chain.from_iterable(rows), dtype=np.int32))

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        if len(self.row) > REMEMBERED:
            self._forget()
        new = set(words).difference(self.row)
        if new:
            marked = sorted(w for w in new if w[:2] == MARK * 2 or w == MARK)
            bare = {MARK + x for x in (w.lstrip(MARK) for w in marked) if x}.difference(self.row)
            plain = sorted(new.difference(marked) | bare)
            if plain:
                self.learn(plain)
            if marked:
                self._learn_marked(marked)
        at, count, ids = self._known()
        row = np.fromiter(map(self.row.__getitem__, words), dtype=np.int64, count=len(words))
        uses = np.bincount(row, minlength=len(self.row))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        sizes = count[row]
        ends = np.cumsum(sizes)
        return ids[np.repeat(at[row] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def encode_flat(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where those of each end). Texts are split into words part by part, long
        ones at a border of words, so that few words are held at once."""
        out, ends, words, chars, done = [], [], [], 0, 0
        marks: list[int] = []  # texts end behind so many words of the part

        def flush() -> None:
            nonlocal words, marks, chars, done
            ids, sizes = self._ids(words)
            out.append(ids)
            upto = np.r_[0, np.cumsum(sizes)]
            ends.extend((done + upto[marks]).tolist())
            done += len(ids)
            words, marks, chars = [], [], 0

        for t in texts:
            t = MARK + t.replace(" ", MARK) if t else ""
            at = 0
            while len(t) - at > PART:
                border = _BORDER.search(t, at + PART)
                if not border:
                    break
                words += _WORDS.findall(t, at, border.end())
                at = border.end()
                flush()
            words += _WORDS.findall(t, at)
            marks.append(len(words))
            chars += len(t) - at
            if chars >= PART:
                flush()
        flush()
        return np.concatenate(out), np.array(ends, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.encode_flat(texts)
        return [x.tolist() for x in np.split(ids, ends[:-1])] if len(ends) else []


def decode(ids, by_id: list[bytes]) -> str:
    """The text of a sequence of ids, without the space that stands before every text."""
    return b"".join([by_id[i] for i in ids])[1:].decode("utf-8", "replace")


def encoded(docs: DataFrame, text: str = "text", model: str = MODEL, check: bool = False) -> DataFrame:
    """Add ``ids`` (array of int) and ``n_tokens``; with ``check`` also ``round_trip``, whether the
    ids decode to the text (with spaces for marks U+2581, which the model has no other sign for).

    Only the driver reads the model file. Null and empty texts have no ids. Rows are encoded one by
    one: repeated rows alike, an empty table gives an empty one, further columns pass through
    (those of the same names are replaced). Long texts are split at borders of words; only a
    single word is indexed whole.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))

    @F.arrow_udf("struct<ids: array<int>, same: boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shipped.value)
        by_id = shipped.value.by_id
        for texts in batches:
            ids, ends = encoder.encode_flat(t.as_py() for t in texts)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], type=pa.int32()), pa.array(ids, type=pa.int32()))
            same = [True] * len(texts)
            if check:
                rows = zip(texts, np.r_[0, ends].tolist(), ends.tolist(), strict=False)
                same = [decode(ids[a:b].tolist(), by_id) == (t.as_py() or "").replace(MARK, " ") for t, a, b in rows]
            yield pa.StructArray.from_arrays([lists, pa.array(same, type=pa.bool_())], ["ids", "same"])

    out = docs.withColumn("__out", run(F.col(text)))
    out = out.withColumn("ids", F.col("__out.ids")).withColumn("n_tokens", F.size("ids").cast("long"))
    return (out.withColumn("round_trip", F.col("__out.same")) if check else out).drop("__out")


def decoded(tokens: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Add ``decoded``, the text of the ids; null and empty ids give an empty text. A mark
    U+2581 of the original comes back as a space, as the model has no other sign for it."""
    shipped = tokens.sparkSession.sparkContext.broadcast(Pieces.load(model).by_id)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array([decode(x.as_py() or (), shipped.value) for x in rows], type=pa.string())

    return tokens.withColumn("decoded", run(F.col(ids)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, check=True).select("doc_id", "n_tokens", "ids", "round_trip")
