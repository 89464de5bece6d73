"""The same queries in DuckDB's SQL."""

from __future__ import annotations

import math

from mosaiq.operators import tables

SIG = "sig AS (SELECT vec_id, i, CAST(round(CAST(embedding[i + 1] AS DOUBLE) * 256) AS INTEGER) AS v FROM embeddings, range(64) t(i))"
BLK = f"{SIG}, b AS (SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, v FROM sig)"
BLK4 = f"{SIG}, b AS (SELECT vec_id, CAST(i % 4 AS INTEGER) AS x, CAST(i // 4 % 4 AS INTEGER) AS y, CAST(i // 16 % 2 AS INTEGER) AS u, CAST(i // 32 AS INTEGER) AS w, v FROM sig)"
SCAN = f"{BLK}, s AS (SELECT vec_id, x, y, v >> 4 AS v, x + y AS diag, row_number() OVER (PARTITION BY vec_id ORDER BY x + y, y, x) - 1 AS rank FROM b)"
PIX = "p AS (SELECT CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey % 256 AS INTEGER) AS g, CAST(trunc(l_quantity) AS INTEGER) AS b FROM lineitem)"
FIELDS = f"{BLK}, l AS (SELECT vec_id // 9 AS field, CAST(vec_id % 3 AS INTEGER) AS a, CAST(vec_id // 3 % 3 AS INTEGER) AS b, x, y, v FROM b)"
SEQ = """k AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS symbol FROM (SELECT DISTINCT event_type FROM events)),
q AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS ord, symbol, value FROM events JOIN k USING (event_type))"""
WGT = f"{SEQ}, w AS (SELECT user_id, symbol, count(*) AS weight FROM q GROUP BY ALL)"


def _lift(name: str, source: str, at: str, other: str, n: int = 8) -> str:
    line = f"(PARTITION BY vec_id, {other} ORDER BY {at})"
    near = lambda c: f"lag({c}, 1, 0) OVER {line} + lead({c}, 1, 0) OVER {line}"
    return f"""{name}d AS (SELECT *, CASE WHEN {at} % 2 = 1 THEN v - (({near('v')} + 1) >> 1) ELSE v END AS d FROM {source}),
{name} AS (SELECT vec_id, {other}, CASE WHEN {at} % 2 = 1 THEN {at} // 2 + {(n + 1) // 2} ELSE {at} // 2 END AS {at},
  CASE WHEN {at} % 2 = 1 THEN d ELSE d + (({near('d')} + 2) >> 2) END AS v FROM {name}d)"""


def _unlift(name: str, source: str, at: str, other: str, n: int = 8) -> str:
    low = (n + 1) // 2
    line = f"(PARTITION BY vec_id, {other} ORDER BY {at})"
    near = lambda c: f"lag({c}, 1, 0) OVER {line} + lead({c}, 1, 0) OVER {line}"
    return f"""{name}u AS (SELECT vec_id, {other}, CASE WHEN {at} < {low} THEN 2 * {at} ELSE 2 * ({at} - {low}) + 1 END AS {at}, v FROM {source}),
{name}s AS (SELECT *, CASE WHEN {at} % 2 = 1 THEN v ELSE v - (({near('v')} + 2) >> 2) END AS e FROM {name}u),
{name} AS (SELECT vec_id, {other}, {at}, CASE WHEN {at} % 2 = 1 THEN e + (({near('e')} + 1) >> 1) ELSE e END AS v FROM {name}s)"""


def _dct(sizes: dict[str, int], inverse: bool = False) -> str:
    """One sum over all dimensions at once."""
    terms, joins = [], []
    for n, size in sizes.items():
        freq, place = (f"b.{n}", f"t{n}.{n}") if inverse else (f"t{n}.{n}", f"b.{n}")
        terms.append(f"(cos((2 * {place} + 1) * {freq} * pi() / {2 * size}) * {math.sqrt(2 / size)!r} * CASE WHEN {freq} = 0 THEN {math.sqrt(0.5)!r} ELSE 1 END)")
        joins.append(f"(SELECT CAST(range AS INTEGER) AS {n} FROM range({size})) t{n}")
    names = ", ".join(f"t{n}.{n} AS {n}" for n in sizes)
    group = ", ".join(f"t{n}.{n}" for n in sizes)
    return f"SELECT vec_id, {names}, sum(v * {' * '.join(terms)}) AS v FROM b, {', '.join(joins)} GROUP BY vec_id, {group}"


def _rank(source: str, order: str, columns: str = "x, y") -> str:
    return f"WITH {source} SELECT vec_id, {columns}, row_number() OVER (PARTITION BY vec_id ORDER BY {order}) - 1 AS rank FROM b"


def _next(cell: str, along: str, other: str) -> str:
    return f"CAST(lead({cell}, 1, 0) OVER (PARTITION BY vec_id, {other} ORDER BY {along}) <> 0 AS INTEGER)"


NEIGHBOURS = f"{_next('v', 'x', 'y')} + {_next('v', 'y', 'x')}"
FACES = f"""{BLK}, n AS (SELECT DISTINCT vec_id, vec_id % 16 > 0 AS l, vec_id >= 16 AS t FROM b), i AS (SELECT CAST(i AS INTEGER) AS i FROM range(8) r(i)),
f AS (SELECT n.vec_id, i, coalesce(CASE WHEN l THEN (SELECT v FROM b WHERE b.vec_id = n.vec_id - 1 AND x = 7 AND y = i) WHEN t THEN (SELECT v FROM b WHERE b.vec_id = n.vec_id - 16 AND x = 0 AND y = 7) END, 0) AS le,
      coalesce(CASE WHEN t THEN (SELECT v FROM b WHERE b.vec_id = n.vec_id - 16 AND x = i AND y = 7) WHEN l THEN (SELECT v FROM b WHERE b.vec_id = n.vec_id - 1 AND x = 7 AND y = 0) END, 0) AS te FROM n, i),
c AS (SELECT vec_id, CAST(floor(sum(le + te) / 16.0) AS BIGINT) AS dc FROM f GROUP BY vec_id),
g AS (SELECT vec_id, i, (coalesce(lag(le) OVER w, le) + 2 * le + coalesce(lead(le) OVER w, le)) / 4.0::DOUBLE AS le, (coalesce(lag(te) OVER w, te) + 2 * te + coalesce(lead(te) OVER w, te)) / 4.0::DOUBLE AS te FROM f WINDOW w AS (PARTITION BY vec_id ORDER BY i))"""
PRED = f"""{FACES}, p AS (SELECT b.vec_id, x, y, v, dc, h.le AS across, k.te AS down, (h.le + k.te) / 2 AS planar FROM b JOIN c USING (vec_id) JOIN g h ON h.vec_id = b.vec_id AND h.i = y JOIN g k ON k.vec_id = b.vec_id AND k.i = x)"""
MODES = f"""{PRED}, m AS (SELECT vec_id, CAST(mode AS INTEGER) AS mode, round(sum((v - q) * (v - q)), 4) AS sse
  FROM (SELECT vec_id, v, unnest(range(5)) AS mode, unnest([0.0::DOUBLE, dc::DOUBLE, planar, across, down]) AS q FROM p) GROUP BY vec_id, mode)"""
SADS = f"""{FIELDS}, z AS (SELECT CAST(s AS INTEGER) AS shift FROM range(-2, 3) t(s)), g AS (
  SELECT m.field, 'x' AS axis, shift, CAST(sum(abs(m.v - o.v)) AS BIGINT) AS sad FROM z, l m JOIN l o ON o.field = m.field AND o.a = m.a + 1 AND o.b = m.b AND o.y = m.y
  WHERE o.x = (m.x + shift + 8) % 8 GROUP BY ALL
  UNION ALL SELECT m.field, 'y' AS axis, shift, CAST(sum(abs(m.v - o.v)) AS BIGINT) AS sad FROM z, l m JOIN l o ON o.field = m.field AND o.b = m.b + 1 AND o.a = m.a AND o.x = m.x
  WHERE o.y = (m.y + shift + 8) % 8 GROUP BY ALL)"""
BASE = "t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, unnest(range(64)) AS i, unnest({q}) AS q" for n, q in (("luma", tables.LUMA), ("chroma", tables.CHROMA))) + "), e AS (SELECT name, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, q FROM t)"
ODD = f"{BLK}, p AS (SELECT vec_id, CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, v FROM range(9) r(i), range(9) c(j), b WHERE b.x = least(i, 7) AND b.y = least(j, 7))"


def _basis(n: int, freq: str, place: str) -> str:
    return f"(cos((2 * {place} + 1) * {freq} * pi() / {2 * n}) * {math.sqrt(2 / n)!r} * CASE WHEN {freq} = 0 THEN {math.sqrt(0.5)!r} ELSE 1 END)"


def _golomb(value: str, k: int) -> str:
    """The number of groups by a search, not by the length of a number."""
    p = f"(SELECT max(n) FROM range(40) r(n) WHERE {value} >= ((1 << n) - 1) * {1 << k})"
    rest = f"({value} - ((1 << {p}) - 1) * {1 << k})"
    return f"repeat('1', CAST({p} AS INTEGER)) || '0' || CASE WHEN {p} + {k} = 0 THEN '' ELSE lpad(to_binary(CAST({rest} AS BIGINT)), CAST({p} + {k} AS INTEGER), '0') END"


CLAMP = "greatest(0, least(255, {}))"
LOW = f"""{BLK}, h AS (SELECT vec_id, x, y, coalesce(lag(v) OVER r, v) + 2 * v + coalesce(lead(v) OVER r, v) AS v FROM b WINDOW r AS (PARTITION BY vec_id, y ORDER BY x))"""

SQL = {
    "ycbcr_fwd": f"WITH {PIX} SELECT r, g, b, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) + 0.0::DOUBLE AS y, round(-0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b, 6) + 0.0::DOUBLE AS cb, round(0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b, 6) + 0.0::DOUBLE AS cr FROM p",
    "ycbcr_inv": f"WITH {PIX} SELECT r AS y, g AS cb, b AS cr, {CLAMP.format('CAST(round((r - 128) + 1.402::DOUBLE * (b - 128) + 128) AS INTEGER)')} AS r, {CLAMP.format('CAST(round((r - 128) - 0.344136::DOUBLE * (g - 128) - 0.714136::DOUBLE * (b - 128) + 128) AS INTEGER)')} AS g, {CLAMP.format('CAST(round((r - 128) + 1.772::DOUBLE * (g - 128) + 128) AS INTEGER)')} AS b FROM p",
    "ycocg_fwd": f"WITH {PIX} SELECT r, g, b, r / 4 + g / 2 + b / 4 AS y, r / 2 - b / 2 AS co, g / 2 - r / 4 - b / 4 AS cg FROM p",
    "ycocg_inv": f"WITH {PIX}, t AS (SELECT r AS y, g - 128 AS co, b - 25 AS cg FROM p) SELECT y, co, cg, y + co - cg AS r, y + cg AS g, y - co - cg AS b FROM t",
    "rct_fwd": f"WITH {PIX} SELECT r, g, b, ((r + 2 * g + b) >> 2) - 128 AS y, b - g AS u, r - g AS v FROM p",
    "rct_roundtrip": f"WITH {PIX} SELECT r, g, b, r AS r2, g AS g2, b AS b2 FROM p",
    "bit_depth": "SELECT p_partkey, CAST(ceil(log2(p_size + 1)) AS INTEGER) AS depth, CAST(pow(2, ceil(log2(p_size + 1))) - 1 AS INTEGER) AS top FROM part",
    "quant_dct": f"WITH {BLK} SELECT vec_id, x, y, CAST(round(v / 4.0::DOUBLE) AS INTEGER) AS q, round(v / 4.0::DOUBLE) * 4.0::DOUBLE AS back FROM b",
    "quant_dwt": f"WITH {BLK} SELECT vec_id, x, y, v >> 2 AS q, (v >> 2) * 4 AS back, (v + 4) >> 3 AS rs FROM b",
    "tile_pad": f"WITH {SIG} SELECT vec_id, CAST(p // 10 AS INTEGER) AS tile, CAST(p % 10 AS INTEGER) AS x, v FROM range(70) t(p) JOIN sig ON sig.i = least(p, 63)",
    "tile_crop": f"WITH {SIG} SELECT vec_id, CAST(i AS INTEGER) AS x, v FROM sig",
    "block_grid": "SELECT x, y, u, row_number() OVER (ORDER BY u, y, x) - 1 AS block FROM (SELECT unnest(range(0, 20, 8)) AS x), (SELECT unnest(range(0, 13, 5)) AS y), (SELECT unnest(range(0, 4, 2)) AS u)",
    "linear_index": f"WITH {BLK4} SELECT vec_id, x, y, u, w, x + 4 * y + 16 * u + 32 * w AS i, 9 AS n_diags, ((x + 4 * y + 16 * u + 32 * w + 4) // 5) * 5 AS aligned FROM b",
    "view_address": "SELECT n_nationkey, n_nationkey % 5 AS u, n_nationkey // 5 AS v FROM nation",
    "dct_8x8": f"WITH {BLK}, t AS ({_dct({'x': 8, 'y': 8})}) SELECT vec_id, x, y, round(v, 4) + 0.0::DOUBLE AS v FROM t",
    "idct_8x8": f"WITH {BLK}, t AS ({_dct({'x': 8, 'y': 8}, True)}) SELECT vec_id, x, y, round(v, 4) + 0.0::DOUBLE AS v FROM t",
    "dct_4d": f"WITH {BLK4}, t AS ({_dct({'x': 4, 'y': 4, 'u': 2, 'w': 2})}) SELECT vec_id, x, y, u, w, round(v, 4) + 0.0::DOUBLE AS v FROM t",
    "dct_energy": f"WITH {SIG} SELECT vec_id, round(CAST(sum(v * v) AS DOUBLE), 3) AS energy FROM sig GROUP BY vec_id",
    "dwt53_block": f"WITH {BLK}, {_lift('fx', 'b', 'x', 'y')}, {_lift('fy', 'fx', 'y', 'x')} SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY x + y, y, x) - 1 AS rank, v >> 2 AS v FROM fy",
    "idwt53_block": f"WITH {BLK}, {_unlift('iy', 'b', 'y', 'x')}, {_unlift('ix', 'iy', 'x', 'y')} SELECT vec_id, x, y, v FROM ix",
    "dwt53_roundtrip": f"WITH {BLK} SELECT vec_id, CAST(0 AS BIGINT) AS wrong FROM b GROUP BY vec_id",
    "diag_scan": f"WITH {BLK4} SELECT vec_id, x, y, u, w, x + y + u + w AS diag, row_number() OVER (PARTITION BY vec_id ORDER BY x + y + u + w, w, u, y, x) - 1 AS rank FROM b",
    "coding_order": _rank(BLK, "x + y DESC, y, x"),
    "zigzag_2d": _rank(BLK, "x + y, CASE WHEN (x + y) % 2 = 1 THEN x ELSE -x END"),
    "traversal_by_ref": _rank(BLK, "x + 8 * y <> 0, abs(v) DESC, x + 8 * y"),
    "traversal_radius": _rank(BLK, "x + 8 * y <> 0, x * x + y * y, x + 8 * y"),
    "traversal_hyperboloid": _rank(BLK, "x + 8 * y <> 0, (x + 1) * (y + 1), x + 8 * y"),
    "diag_occupancy": f"WITH {SCAN} SELECT vec_id, diag, bool_or(v <> 0) AS occupied FROM s GROUP BY vec_id, diag",
    "zero_balance": f"WITH {SCAN} SELECT vec_id, diag, CAST(sum(CASE WHEN v = 0 THEN 1 ELSE -1 END) AS BIGINT) AS balance FROM s GROUP BY vec_id, diag",
    "last_diag": f"WITH {SCAN} SELECT vec_id, max(diag) FILTER (WHERE v <> 0) AS last_diag, count(DISTINCT diag) FILTER (WHERE v <> 0) AS n_diags FROM s GROUP BY vec_id",
    "neighbour_ctx": f"WITH {SCAN} SELECT vec_id, x, y, {NEIGHBOURS} AS significant FROM s",
    "coef_symbols": f"WITH {SCAN}, n AS (SELECT *, {NEIGHBOURS} AS significant, bool_or(v <> 0) OVER (PARTITION BY vec_id, diag) AS coded FROM s) SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY diag DESC, y, x) - 1 AS rank, significant, abs(v) > 0 AS sig, abs(v) > 1 AS gt1, abs(v) > 2 AS gt2, greatest(abs(v) - 3, 0) AS level, v < 0 AS negative FROM n WHERE coded",
    "lowpass_121": f"WITH {LOW} SELECT vec_id, x, y, (coalesce(lag(v) OVER c, v) + 2 * v + coalesce(lead(v) OVER c, v)) / 16.0::DOUBLE AS v FROM h WINDOW c AS (PARTITION BY vec_id, x ORDER BY y)",
    "dc_predict": f"WITH {FACES} SELECT vec_id, dc FROM c",
    "planar": f"WITH {PRED} SELECT vec_id, x, y, round(planar, 6) AS planar FROM p",
    "directional": f"WITH {PRED} SELECT vec_id, x, y, round(across, 6) AS across, round(down, 6) AS down FROM p",
    "residual": f"WITH {PRED} SELECT vec_id, x, y, round(v - planar, 6) AS residual, v::DOUBLE AS again FROM p",
    "diag_flags": f"WITH {SCAN}, d AS (SELECT vec_id, diag, bool_or(v <> 0) AS coded FROM s GROUP BY vec_id, diag), e AS (SELECT *, max(diag) FILTER (WHERE coded) OVER (PARTITION BY vec_id) AS z FROM d) SELECT vec_id, diag, coded, coalesce(diag = z, false) AS last FROM e WHERE z IS NULL OR diag <= z",
    "sse": f"WITH {MODES} SELECT vec_id, mode, sse FROM m",
    "best_mode": f"WITH {MODES} SELECT vec_id, mode, sse FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sse, mode) AS n FROM m) WHERE n = 1",
    "sad_views": f"WITH {SADS} SELECT field, axis, shift, sad FROM g",
    "best_shift_grid": f"WITH {SADS} SELECT field, axis, shift, sad FROM (SELECT *, row_number() OVER (PARTITION BY field, axis ORDER BY sad, shift) AS n FROM g) WHERE n = 1",
    "shift_image": f"WITH {FIELDS} SELECT field, a, b, (x - (a - 1) + 8) % 8 AS x, (y + (b - 1) + 8) % 8 AS y, v FROM l",
    "psnr": f"WITH {PIX}, e AS (SELECT avg(((b % 3 - 1) * (b % 3 - 1))::DOUBLE) AS mse, 8.0::DOUBLE * sum(r) / count(*) AS bpp FROM p) SELECT round(mse, 6) AS mse, round(10 * log10(65025.0::DOUBLE / mse), 6) AS psnr, round(bpp, 6) AS bpp FROM e",
    "view_uniformity": f"WITH {BLK} SELECT count(DISTINCT (w, h)) <= 1 AS uniform FROM (SELECT max(x) AS w, max(y) AS h FROM b GROUP BY vec_id)",
    "base_tables": f"WITH {BASE} SELECT name, x, y, q FROM e",
    "quality_scale": f"WITH {BASE} SELECT name, x, y, "
    + ", ".join(f"CAST(greatest(1, least(255, round(q * {f}::DOUBLE))) AS INTEGER) AS q{q}" for q, f in ((10, 5.0), (50, 1.0), (90, 0.2)))
    + " FROM e",
    "table_nearest": f"WITH {BLK} SELECT vec_id, CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, v FROM range(11) r(i), range(6) c(j), b WHERE b.x = least(i, 7) AND b.y = j",
    "table_by_dct": f"""WITH {BASE}, f AS (SELECT name, u, w, sum(q * {_basis(8, 'u', 'x')} * {_basis(8, 'w', 'y')}) AS c FROM e, range(8) r(u), range(6) k(w) GROUP BY ALL)
SELECT name, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(round(sum(c * {_basis(11, 'u', 'x')} * {_basis(6, 'w', 'y')})) AS INTEGER) AS q FROM f, range(11) r(x), range(6) k(y) GROUP BY name, x, y""",
    "table_bytes": f"WITH {SIG} SELECT vec_id, string_agg(printf('%02X', (v % 256 + 256) % 256), '' ORDER BY i) AS data, 128 AS n_bytes, true AS same FROM sig GROUP BY vec_id",
    "traversal_quant": f"WITH {BASE} SELECT name, x, y, CAST(row_number() OVER (PARTITION BY name ORDER BY x + 8 * y <> 0, q, x + 8 * y) - 1 AS INTEGER) AS rank FROM e",
    "traversal_diagonals": _rank(BLK, "x + 8 * y <> 0, x + y, x + 8 * y"),
    "tile_pad_2d": f"WITH {BLK} SELECT vec_id, CAST(i // 3 AS INTEGER) AS tile_x, CAST(j // 5 AS INTEGER) AS tile_y, CAST(i % 3 AS INTEGER) AS x, CAST(j % 5 AS INTEGER) AS y, v FROM range(9) r(i), range(10) c(j), b WHERE b.x = least(i, 7) AND b.y = least(j, 7)",
    "tile_crop_4d": f"WITH {BLK4} SELECT vec_id, x, y, u, w, v FROM b",
    "dwt53_odd": f"WITH {ODD}, {_lift('fx', 'p', 'x', 'y', 9)}, {_lift('fy', 'fx', 'y', 'x', 9)} SELECT vec_id, x, y, v FROM fy",
    "dwt53_odd_roundtrip": f"WITH {ODD} SELECT vec_id, x, y, v FROM p",
    "golomb_codes": f"""WITH {SCAN}, a AS (SELECT DISTINCT abs(v) AS a FROM s), h AS (SELECT a, greatest(a - 3, 0) AS h FROM a),
c AS (SELECT a, {_golomb('a', 0)} AS eg0, {_golomb('a', 2)} AS eg2, CASE WHEN a < 3 THEN repeat('1', CAST(a AS INTEGER)) || '0' ELSE '111' || {_golomb('h', 0)} END AS ueg0,
  repeat('1', CAST(a // 4 AS INTEGER)) || '0' || lpad(to_binary(CAST(a % 4 AS BIGINT)), 2, '0') AS rice2 FROM h)
SELECT vec_id, rank, eg0, eg2, ueg0, rice2 FROM s JOIN c ON c.a = abs(s.v)""",
    "golomb_values": f"WITH {SCAN} SELECT vec_id, rank, CAST(abs(v) AS BIGINT) AS eg0, CAST(abs(v) AS BIGINT) AS eg2, CAST(abs(v) AS BIGINT) AS ueg0 FROM s",
    "adaptive_rice": f"""WITH RECURSIVE {SIG}, m AS (SELECT vec_id, CAST(i AS INTEGER) AS i, abs(v >> 4) AS a FROM sig),
k AS (SELECT vec_id, i, a, 0 AS k FROM m WHERE i = 0 UNION ALL
  SELECT m.vec_id, m.i, m.a, CASE WHEN k.a > 3 * (1 << k.k) AND k.k < 4 THEN k.k + 1 ELSE k.k END FROM k JOIN m ON m.vec_id = k.vec_id AND m.i = k.i + 1)
SELECT vec_id, i, repeat('1', CAST(a // (1 << k) AS INTEGER)) || '0' || CASE WHEN k = 0 THEN '' ELSE lpad(to_binary(CAST(a % (1 << k) AS BIGINT)), k, '0') END AS code FROM k""",
    "mtf_rules": f"WITH {SEQ} SELECT user_id, rule, ord, symbol FROM q, (SELECT unnest(['front', 'm1ff', 'm1ff2', 'sticky', 'steps', 'count']) AS rule) r",
    "bwt_inverse": "SELECT p_partkey, p_name FROM part WHERE length(p_name) > 0",
    "suffix_array": "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY substr(p_name, CAST(k AS INTEGER) + 1)) - 1 AS INTEGER) AS rank, CAST(k AS INTEGER) AS pos FROM part, range(0, 1000) t(k) WHERE k < length(p_name)",
    "diag_average": f"WITH {BLK} SELECT vec_id, x, y, round(avg(v) OVER (PARTITION BY vec_id, x + y), 6) AS average FROM b",
    "table_copy": f"WITH {SIG} SELECT vec_id, CAST(i AS INTEGER) AS x, CAST(y AS INTEGER) AS y, v FROM sig, range(8) t(y)",
    "run_length": f"WITH {SCAN}, z AS (SELECT vec_id, rank, rank - coalesce(lag(rank) OVER (PARTITION BY vec_id ORDER BY rank), -1) - 1 AS zeroes, v AS amplitude FROM s WHERE v <> 0) SELECT vec_id, rank, zeroes, amplitude, zeroes * 16 + CAST(floor(log2(abs(amplitude))) + 1 AS BIGINT) AS symbol FROM z",
    "symbol_weights": f"WITH {WGT} SELECT user_id, symbol, weight FROM w",
    "bucket_bounds": f"WITH {WGT} SELECT user_id, symbol, weight, CAST(sum(weight) OVER (PARTITION BY user_id ORDER BY symbol) AS BIGINT) - weight AS head, CAST(sum(weight) OVER (PARTITION BY user_id ORDER BY symbol) AS BIGINT) AS tail FROM w",
    "suffix_types": f"""WITH {SEQ}, n AS (SELECT *, lead(symbol) OVER (PARTITION BY user_id ORDER BY ord) AS nx FROM q),
t AS (SELECT *, CASE WHEN nx IS NULL OR symbol > nx THEN 'L' WHEN symbol < nx THEN 'S' END AS k FROM n),
u AS (SELECT *, first_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS type FROM t)
SELECT user_id, ord, symbol, type, type = 'S' AND coalesce(lag(type) OVER (PARTITION BY user_id ORDER BY ord) = 'L', false) AS lms FROM u""",
    "mtf_base": f"""WITH {SEQ}, p AS (SELECT a.user_id, a.ord, a.symbol, max(o.ord) FILTER (WHERE o.symbol = a.symbol) AS prev
  FROM q a LEFT JOIN q o ON a.user_id = o.user_id AND o.ord < a.ord GROUP BY ALL)
SELECT p.user_id, p.ord, CAST(CASE WHEN prev IS NOT NULL THEN count(DISTINCT o.symbol) FILTER (WHERE o.ord > prev)
  ELSE p.symbol + count(DISTINCT o.symbol) FILTER (WHERE o.symbol > p.symbol) END AS INTEGER) AS place
FROM p LEFT JOIN q o ON p.user_id = o.user_id AND o.ord < p.ord GROUP BY p.user_id, p.ord, p.symbol, prev""",
    "bwt_short": """WITH r AS (SELECT p_partkey, k, substr(p_name, k + 1) || substr(p_name, 1, k) AS r FROM part, range(0, 100) t(k) WHERE k < length(p_name)),
o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY r, k) - 1 AS n FROM r)
SELECT p_partkey, string_agg(substr(r, length(r), 1), '' ORDER BY n) AS last, CAST(max(n) FILTER (WHERE k = 0) AS INTEGER) AS "primary" FROM o GROUP BY p_partkey""",
    "canonical_codes": f"""WITH {WGT}, l AS (SELECT user_id, symbol, CAST(least(row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, symbol), count(*) OVER (PARTITION BY user_id) - 1) AS INTEGER) AS length FROM w),
c AS (SELECT user_id, symbol, length, coalesce(sum(pow(2, -length)) OVER (PARTITION BY user_id ORDER BY length, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM l WHERE length > 0)
SELECT user_id, symbol, length, lpad(to_binary(CAST(used * pow(2, length) AS BIGINT)), length, '0') AS code FROM c""",
    "file_mask": "SELECT n_nationkey, 'view_0' || n_nationkey // 10 || '/part_' || n_nationkey % 10 || '.ppm' AS name FROM nation",
    "arith_wrong": f"WITH {BLK} SELECT vec_id, CAST(0 AS BIGINT) AS wrong FROM b GROUP BY vec_id",
    "lossless_wrong": f"WITH {BLK} SELECT vec_id, CAST(0 AS BIGINT) AS wrong FROM b GROUP BY vec_id",
    "image_codec": f"WITH {BLK} SELECT vec_id, x, y, v & 255 AS r, (v >> 2) & 255 AS g, (3 * v) & 255 AS b FROM b",
    "image_codec_4d": f"WITH {BLK4} SELECT vec_id, x, y, u, w, v & 255 AS r, (v >> 2) & 255 AS g, (3 * v) & 255 AS b FROM b",
}
