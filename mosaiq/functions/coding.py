"""Sequential coders. State runs through a stream, so each stream is one group in one task;
streams run side by side."""

from __future__ import annotations

import heapq
from collections import Counter, deque
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators import color, transforms

#: Updates a list after the symbol at a place was coded.
Rule = Callable[[list[int], int], None]

# The probability of the less probable symbol falls by this factor from state to state, from
# 1/2 to 3/160 over 63 states (Marpe, Schwarz, Wiegand, 2003).
_STATES = 64
_FALL = (0.01875 / 0.5) ** (1 / (_STATES - 1))
_LESS = [0.5 * _FALL**s for s in range(_STATES)]
#: Width of the less probable part by state and by the quarter of the range 256..511.
_WIDTH = [[max(6, round(p * (288 + 64 * q))) for q in range(4)] for p in _LESS]
_AFTER_MORE = [min(s + 1, _STATES - 2) for s in range(_STATES)]
_AFTER_LESS = [max(0, min(range(_STATES), key=lambda t: abs(_LESS[t] - min(0.5, p * _FALL + 1 - _FALL)))) for p in _LESS]
_BITS = 10


class BitWriter:
    """Bits into bytes, the lowest bit first; the last byte is filled with zeros."""

    def __init__(self) -> None:
        self.bits: list[int] = []

    def write(self, bit: int) -> None:
        self.bits.append(bit)

    def value(self) -> bytes:
        out = bytearray((len(self.bits) + 7) // 8)
        for k, bit in enumerate(self.bits):
            out[k >> 3] |= bit << (k & 7)
        return bytes(out)


class BitReader:
    """The reverse; past the end all bits are 1."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def read(self) -> int:
        at, self.at = self.at, self.at + 1
        return self.data[at >> 3] >> (at & 7) & 1 if at >> 3 < len(self.data) else 1


class Context:
    """The adaptive state of one binary decision."""

    __slots__ = ("state", "most")

    def __init__(self) -> None:
        self.state, self.most = 0, 0

    def learn(self, bit: int) -> None:
        if bit == self.most:
            self.state = _AFTER_MORE[self.state]
        else:
            if self.state == 0:
                self.most ^= 1
            self.state = _AFTER_LESS[self.state]


class Encoder:
    """Binary arithmetic coder over a range of 9 bits with carries held back."""

    def __init__(self) -> None:
        self.out, self.low, self.range, self.held, self.first = BitWriter(), 0, 510, 0, True

    def _put(self, bit: int) -> None:
        if self.first:
            self.first = False
        else:
            self.out.write(bit)
        for _ in range(self.held):
            self.out.write(1 - bit)
        self.held = 0

    def _scale(self) -> None:
        top = 1 << _BITS
        while self.range < top // 4:
            self._shift()

    def _shift(self) -> None:
        half = 1 << (_BITS - 1)
        if self.low >= half:
            self._put(1)
            self.low -= half
        elif self.low < half // 2:
            self._put(0)
        else:
            self.held += 1
            self.low -= half // 2
        self.low, self.range = self.low * 2, self.range * 2

    def bit(self, bit: int, context: Context) -> None:
        less = _WIDTH[context.state][self.range >> 6 & 3]
        self.range -= less
        if bit != context.most:
            self.low, self.range = self.low + self.range, less
        context.learn(bit)
        self._scale()

    def plain(self, bit: int) -> None:
        """A bit without a context: half the range each."""
        self.low *= 2
        if bit:
            self.low += self.range
        top = 1 << _BITS
        if self.low >= top:
            self._put(1)
            self.low -= top
        elif self.low < top // 2:
            self._put(0)
        else:
            self.held += 1
            self.low -= top // 2

    def value(self) -> bytes:
        self.range = 2
        self._scale()
        half = 1 << (_BITS - 1)
        self._put(int(self.low >= half))
        self.out.write(int(self.low % half >= half // 2))
        self.out.write(1)
        return self.out.value()


class Decoder:
    def __init__(self, data: bytes) -> None:
        self.source, self.range, self.at = BitReader(data), 510, 0
        for _ in range(_BITS - 1):
            self.at = self.at * 2 + self.source.read()

    def bit(self, context: Context) -> int:
        less = _WIDTH[context.state][self.range >> 6 & 3]
        self.range -= less
        bit = context.most
        if self.at >= self.range:
            bit ^= 1
            self.at, self.range = self.at - self.range, less
        context.learn(bit)
        while self.range < 1 << (_BITS - 2):
            self.range, self.at = self.range * 2, self.at * 2 + self.source.read()
        return bit

    def plain(self) -> int:
        self.at = self.at * 2 + self.source.read()
        if self.at >= self.range:
            self.at -= self.range
            return 1
        return 0


class LevelModel:
    """Contexts of a block's levels: significance, above 1, above 2 and the rest as an exponential Golomb
    code, its prefix with a context for each place, its suffix plain."""

    def __init__(self) -> None:
        self.parts = [Context() for _ in range(3)]
        self.prefix = [Context() for _ in range(32)]

    def encode(self, coder: Encoder, level: int) -> None:
        size = abs(level)
        for k in range(3):
            coder.bit(int(size > k), self.parts[k])
            if size <= k:
                break
        else:
            rest = size - 2
            n = rest.bit_length() - 1
            for k in range(n):
                coder.bit(1, self.prefix[k])
            coder.bit(0, self.prefix[n])
            for k in reversed(range(n)):
                coder.plain(rest >> k & 1)
        if size:
            coder.plain(int(level < 0))

    def decode(self, coder: Decoder) -> int:
        size = 0
        while size < 3 and coder.bit(self.parts[size]):
            size += 1
        if size == 3:
            n, rest = 0, 1
            while coder.bit(self.prefix[n]):
                n += 1
            for _ in range(n):
                rest = rest * 2 + coder.plain()
            size = rest + 2
        return -size if size and coder.plain() else size


def encode_levels(levels: list[int]) -> bytes:
    coder, model = Encoder(), LevelModel()
    for level in levels:
        model.encode(coder, level)
    return coder.value()


def decode_levels(data: bytes, n: int) -> list[int]:
    coder, model = Decoder(data), LevelModel()
    return [model.decode(coder) for _ in range(n)]


def coded_blocks(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Each block as a stream of its own: (keys, n_bytes, wrong), wrong being the levels that do
    not come back."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        levels = part.sort_values("rank")["v"].tolist()
        data = encode_levels(levels)
        back = decode_levels(data, len(levels))
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "n_bytes": [len(data)], "wrong": [sum(a != b for a, b in zip(levels, back, strict=True))]})

    kinds = ", ".join(f"{k} {dict(scanned.dtypes)[k]}" for k in keys)
    return scanned.select(*keys, "rank", "v").groupBy(*keys).applyInPandas(run, f"{kinds}, n_bytes long, wrong long")


def wavelet_roundtrip(blocks: DataFrame, keys: list[str], sizes: dict[str, int], bits: int = 0) -> DataFrame:
    """Wavelet, quantiser, entropy coder and all of it back: (keys, n_bytes, wrong)."""
    there = transforms.dwt53(blocks, keys, sizes).withColumn("v", color.shift_quantised(F.col("v"), bits))
    names = list(sizes)
    packed = there.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*reversed(names), "v"))).alias("cells"))

    @F.pandas_udf("data binary, v array<int>")
    def code(cells: pd.Series) -> pd.DataFrame:
        levels = [[int(c["v"]) for c in row] for row in cells]
        data = [encode_levels(x) for x in levels]
        return pd.DataFrame({"data": data, "v": [decode_levels(x, len(y)) for x, y in zip(data, levels, strict=True)]})

    coded = packed.withColumn("__c", code("cells"))
    rows = coded.select(*keys, F.octet_length("__c.data").alias("n_bytes"), F.posexplode(F.arrays_zip("cells", F.col("__c.v").alias("back"))).alias("p", "z"))
    cells = rows.select(*keys, "n_bytes", *(F.col(f"z.cells.{n}").alias(n) for n in names), color.shift_dequantised(F.col("z.back"), bits).alias("v"))
    back = transforms.idwt53(cells, keys, sizes)
    both = back.join(blocks.withColumnRenamed("v", "__o"), [*keys, *names])
    return both.groupBy(*keys).agg(F.max("n_bytes").cast("long").alias("n_bytes"), F.count_if(F.col("v") != F.col("__o")).alias("wrong"))


def _moved(line: list[int], at: int, to: int) -> None:
    line.insert(to, line.pop(at))


def _to_front() -> Rule:
    return lambda line, at: _moved(line, at, 0)


def _second_first() -> Rule:
    """Only a symbol from the second place goes to the first; others go to the second."""
    return lambda line, at: _moved(line, at, min(1, at - 1) if at else 0)


def _two_seen() -> Rule:
    """As before, but to the first place if its symbol is neither of the last two."""
    seen = deque([0, 0], maxlen=2)

    def update(line: list[int], at: int) -> None:
        symbol = line[at]
        _moved(line, at, 1 if at > 1 and line[0] in seen else 0)
        seen.append(symbol)

    return update


def _sticky(part: float = 0.5) -> Rule:
    """To a part of its place, rounded half up."""
    return lambda line, at: _moved(line, at, int(at * part + 0.5))


def _by_steps(steps: int = 2) -> Rule:
    return lambda line, at: _moved(line, at, max(0, at - steps))


def _after_count(least: int = 2) -> Rule:
    """To the front once its count has come to ``least``; then the symbol at the old place counts."""
    counts: Counter[int] = Counter()

    def update(line: list[int], at: int) -> None:
        if counts[line[at]] >= least:
            _moved(line, at, 0)
        counts[line[at]] += 1

    return update


#: Each makes a rule with memory of its own, for one sequence.
RULES = {"front": _to_front, "m1ff": _second_first, "m1ff2": _two_seen, "sticky": _sticky, "steps": _by_steps, "count": _after_count}


def places_of(symbols: Iterable[int], rule: Rule) -> list[int]:
    """The place of each symbol in a list that starts as 0, 1, 2, ... and grows on demand."""
    line: list[int] = []
    found = []
    for s in symbols:
        if s >= len(line):
            line += range(len(line), s + 1)
        found.append(line.index(s))
        rule(line, found[-1])
    return found


def symbols_of(places: Iterable[int], rule: Rule) -> list[int]:
    """The inverse of ``places_of`` under the same rule."""
    line: list[int] = []
    found = []
    for at in places:
        if at >= len(line):
            line += range(len(line), at + 1)
        found.append(line[at])
        rule(line, at)
    return found


def _by_sequence(df: DataFrame, keys: list[str], order: str, value: str, out: str, run: Callable[[list[int]], list[int]]) -> DataFrame:
    def whole(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        return part[[*keys, order]].assign(**{out: run(part[value].tolist())})

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, order]) + f", {out} int"
    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(whole, schema)


def move_to_front(df: DataFrame, keys: list[str], order: str, symbol: str, rule: str = "front") -> DataFrame:
    """(keys, order, place): each sequence coded under one of ``RULES``. A sequence must fit a task."""
    return _by_sequence(df, keys, order, symbol, "place", lambda s: places_of(s, RULES[rule]()))


def move_from_front(df: DataFrame, keys: list[str], order: str, place: str = "place", rule: str = "front") -> DataFrame:
    """(keys, order, symbol): the inverse."""
    return _by_sequence(df, keys, order, place, "symbol", lambda p: symbols_of(p, RULES[rule]()))


def code_lengths(weights: dict[int, int]) -> dict[int, int]:
    """Least-cost prefix code lengths; one symbol alone has length 0."""
    heap = [(w, s, (s,)) for s, w in weights.items()]
    heapq.heapify(heap)
    lengths = dict.fromkeys(weights, 0)
    while len(heap) > 1:
        (w1, s1, a), (w2, s2, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            lengths[s] += 1
        heapq.heappush(heap, (w1 + w2, min(s1, s2), a + b))
    return lengths


def huffman_lengths(weights: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """(keys, symbol, weight, length)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = code_lengths(dict(zip(part[symbol].tolist(), part["weight"].tolist(), strict=True)))
        return part[[*keys, symbol, "weight"]].assign(length=[found[x] for x in part[symbol].tolist()])

    kinds = dict(weights.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, symbol, "weight"]) + ", length int"
    return weights.groupBy(*keys).applyInPandas(run, schema)
