"""Signal queries: each applies an operator to a signal derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.functions import codec, coding
from mosaiq.functions.masks import filled_mask
from mosaiq.operators import binarization, blocks, color, prediction, scans, sequences, statistics, tables, transforms
from mosaiq.sources import containers

XY, K = {"x": 8, "y": 8}, ["vec_id"]
XYUW = {"x": 4, "y": 4, "u": 2, "w": 2}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def signal(s, d) -> DataFrame:
    return blocks.signal(table(s, d, "embeddings"))


def block(s, d) -> DataFrame:
    return blocks.shaped(signal(s, d), XY)


def block4(s, d) -> DataFrame:
    return blocks.shaped(signal(s, d), XYUW)


def scanned(s, d) -> DataFrame:
    """The quantised block in scan order, from which coefficient statistics are taken."""
    b = block(s, d).withColumn("v", color.shift_quantised(F.col("v"), 4))
    return scans.diagonal_scan(b, K, ["x", "y"])


def pixels(s, d) -> DataFrame:
    return table(s, d, "lineitem").select(
        (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") % 256).cast("int").alias("g"), F.col("l_quantity").cast("int").alias("b")
    )


def _rgb():
    return F.col("r"), F.col("g"), F.col("b")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Rounded to six digits, with no negative zero."""
    return df.withColumns({n: F.round(F.col(n), 6) + 0.0 for n in names})


#: Views of a light field along each axis.
SIDE = 3


def light_fields(s, d) -> DataFrame:
    """Nine embeddings in a row are the views of one light field: (field, a, b, v), views in a square, samples as an array."""
    k = F.col("vec_id")
    samples = F.transform("embedding", lambda e: F.round(e.cast("double") * 256).cast("int"))
    return table(s, d, "embeddings").select(
        F.floor(k / SIDE**2).alias("field"), (k % SIDE).cast("int").alias("a"), (F.floor(k / SIDE) % SIDE).cast("int").alias("b"), samples.alias("v")
    )


def sequence(s, d) -> DataFrame:
    """Event types of each user in order, as symbols."""
    e = table(s, d, "events").select("user_id", "event_id", "event_type", "value")
    kinds = e.select("event_type").distinct()  # one row for each symbol of the alphabet
    kinds = kinds.select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).alias("symbol"))
    line = Window.partitionBy("user_id").orderBy("event_id")
    return e.join(kinds, "event_type").select("user_id", (F.row_number().over(line) - 1).alias("ord"), "symbol", "value")


def dwt53_block(s, d):
    t = transforms.dwt53(block(s, d), K, XY).withColumn("v", color.shift_quantised(F.col("v"), 2))
    return scans.diagonal_scan(t, K, ["x", "y"]).select("vec_id", "rank", "v")


def idwt53_block(s, d):
    return transforms.idwt53(block(s, d), K, XY).select("vec_id", "x", "y", "v")


def dwt53_roundtrip(s, d):
    there = transforms.dwt53(block(s, d), K, XY)
    back = transforms.idwt53(there, K, XY)
    return back.join(block(s, d).withColumnRenamed("v", "o"), ["vec_id", "x", "y"]).groupBy("vec_id").agg(F.count_if(F.col("v") != F.col("o")).alias("wrong"))


def dct_8x8(s, d):
    t = transforms.dct(block(s, d), K, XY)
    return t.select("vec_id", "x", "y", (F.round("v", 4) + 0.0).alias("v"))


def idct_8x8(s, d):
    return transforms.dct(block(s, d), K, XY, inverse=True).select("vec_id", "x", "y", (F.round("v", 4) + 0.0).alias("v"))


def dct_4d(s, d):
    return transforms.dct(block4(s, d), K, XYUW).select(*K, *XYUW, (F.round("v", 4) + 0.0).alias("v"))


def dct_energy(s, d):
    t = transforms.dct(block(s, d), K, XY).groupBy("vec_id").agg(F.round(F.sum(F.col("v") * F.col("v")), 3).alias("energy"))
    return t


def quant_dct(s, d):
    return block(s, d).select("vec_id", "x", "y", color.quantised(F.col("v").cast("double"), 2).cast("int").alias("q"), color.dequantised(color.quantised(F.col("v").cast("double"), 2), 2).alias("back"))


def quant_dwt(s, d):
    q = color.shift_quantised(F.col("v"), 2)
    return block(s, d).select("vec_id", "x", "y", q.alias("q"), color.shift_dequantised(q, 2).alias("back"), color.rounding_shift(F.col("v"), 3).alias("rs"))


def ycbcr_fwd(s, d):
    return _rounded(pixels(s, d).select("r", "g", "b", *color.rgb_to_ycbcr(*_rgb())), "y", "cb", "cr")


def ycbcr_inv(s, d):
    p = color.ycbcr_to_rgb(F.col("r") - 128, F.col("g") - 128, F.col("b") - 128)
    return pixels(s, d).select(F.col("r").alias("y"), F.col("g").alias("cb"), F.col("b").alias("cr"), *(color.output_sample(c + 128).alias(n) for c, n in zip(p, "rgb", strict=True)))


def ycocg_fwd(s, d):
    return pixels(s, d).select("r", "g", "b", *color.rgb_to_ycocg(*_rgb()))


def ycocg_inv(s, d):
    p = pixels(s, d).select(F.col("r").alias("y"), (F.col("g") - 128).alias("co"), (F.col("b") - 25).alias("cg"))
    return p.select("*", *color.ycocg_to_rgb(F.col("y"), F.col("co"), F.col("cg")))


def rct_fwd(s, d):
    return pixels(s, d).select("r", "g", "b", *color.rct_forward(*_rgb()))


def rct_roundtrip(s, d):
    t = pixels(s, d).select("r", "g", "b", *color.rct_forward(*_rgb()))
    back = color.rct_inverse(F.col("y"), F.col("u"), F.col("v"))
    return t.select("r", "g", "b", *(c.alias(f"{n}2") for c, n in zip(back, "rgb", strict=True)))


def bit_depth(s, d):
    return table(s, d, "part").select("p_partkey", color.bit_depth(F.col("p_size")).alias("depth"), (F.pow(F.lit(2), color.bit_depth(F.col("p_size"))) - 1).cast("int").alias("top"))


def tile_pad(s, d):
    return blocks.padded_tiles(signal(s, d), K, 64, 10).withColumnRenamed("i", "x")


def tile_crop(s, d):
    return blocks.cropped(blocks.padded_tiles(signal(s, d), K, 64, 10), 64, 10).withColumnRenamed("i", "x")


def block_grid(s, d):
    return blocks.block_grid(s, {"x": 20, "y": 13, "u": 4}, {"x": 8, "y": 5, "u": 2})


def linear_index(s, d):
    b = block4(s, d)
    back = blocks.linear_index(list(XYUW), list(XYUW.values()))
    return b.select("vec_id", *XYUW, back.alias("i"), F.lit(blocks.num_diagonals(list(XYUW.values()))).alias("n_diags"), blocks.aligned(back, 5).alias("aligned"))


def view_address(s, d):
    n = table(s, d, "nation")
    return n.select("n_nationkey", *blocks.view_address("n_nationkey", 5))


def diag_scan(s, d):
    return scans.diagonal_scan(block4(s, d), K, list(XYUW)).select("vec_id", *XYUW, "diag", "rank")


def coding_order(s, d):
    return scans.coding_order(block(s, d), K, ["x", "y"]).select("vec_id", "x", "y", "rank")


def zigzag_2d(s, d):
    return scans.zigzag(block(s, d), K).select("vec_id", "x", "y", "rank")


def _traversal(s, d, reference):
    return scans.traversal(block(s, d), K, reference, F.col("x") + 8 * F.col("y")).select("vec_id", "x", "y", "rank")


def traversal_by_ref(s, d):
    return _traversal(s, d, F.abs("v"))


def traversal_radius(s, d):
    return _traversal(s, d, scans.radius(["x", "y"]))


def traversal_hyperboloid(s, d):
    return _traversal(s, d, scans.hyperboloid(["x", "y"]))


def diag_occupancy(s, d):
    return statistics.diagonal_counts(scanned(s, d), K).select("vec_id", "diag", "occupied")


def zero_balance(s, d):
    return statistics.diagonal_counts(scanned(s, d), K).select("vec_id", "diag", "balance")


def last_diag(s, d):
    return statistics.last_diagonal(scanned(s, d), K)


def neighbour_ctx(s, d):
    return statistics.significant_neighbours(scanned(s, d), K, ["x", "y"]).select("vec_id", "x", "y", "significant")


def coef_symbols(s, d):
    """The binary decisions of each coefficient, in coding order, with their context. Diagonals
    without a coefficient are not coded."""
    b = statistics.significant_neighbours(scanned(s, d), K, ["x", "y"])
    some = F.max(F.col("v") != 0).over(Window.partitionBy("vec_id", "diag"))
    b = b.withColumn("some", some).where("some")
    b = scans.coding_order(b.drop("rank", "some"), K, ["x", "y"])
    a = F.abs("v")
    return b.select("vec_id", "rank", "significant", (a > 0).alias("sig"), (a > 1).alias("gt1"), (a > 2).alias("gt2"), F.greatest(a - 3, F.lit(0)).alias("level"), (F.col("v") < 0).alias("negative"))


def diag_flags(s, d):
    """The flags before the coefficients: whether each diagonal has any, up to the last that has, and
    for those that have whether it is the last."""
    return scans.diagonal_flags(scanned(s, d), K)


def lowpass_121(s, d):
    return prediction.low_pass(block(s, d), K, ["x", "y"]).select("vec_id", "x", "y", "v")


#: Blocks beside each other in the image that all embeddings make, by vec_id.
ACROSS = 16


def _beside(s, d) -> DataFrame:
    samples = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.round(e.cast("double") * 256).cast("int")).alias("v"))
    return prediction.faces(samples, "vec_id", ACROSS, 8)


def dc_predict(s, d):
    return prediction.dc_prediction(_beside(s, d), "vec_id", 8)


def _predicted(s, d) -> DataFrame:
    return block(s, d).select("vec_id", "x", "y", "v").join(prediction.predictions(_beside(s, d), "vec_id", 8), ["vec_id", "x", "y"])


def planar(s, d):
    return _rounded(_predicted(s, d).select("vec_id", "x", "y", "planar"), "planar")


def directional(s, d):
    """Directions (2, 0) and (0, 2)."""
    return _rounded(_predicted(s, d).select("vec_id", "x", "y", "across", "down"), "across", "down")


def residual(s, d):
    """What is left after planar prediction, and the block again."""
    p = _predicted(s, d)
    out = p.select("vec_id", "x", "y", (F.col("v") - F.col("planar")).alias("residual"), (F.col("v") - F.col("planar") + F.col("planar")).alias("again"))
    return _rounded(out, "residual", "again")


MODES = ("none", "dc", "planar", "across", "down")


def _modes(s, d) -> DataFrame:
    """Errors of the ways to predict a block: nothing, DC, planar, and the directions along an axis."""
    rows = _predicted(s, d).select("vec_id", "v", F.posexplode(F.array(*MODES)).alias("mode", "p"))
    error = rows.groupBy("vec_id", "mode").agg(F.sum((F.col("v") - F.col("p")) * (F.col("v") - F.col("p"))).alias("sse"))
    return error.withColumn("sse", F.round("sse", 4))


def sse(s, d):
    return _modes(s, d)


def best_mode(s, d):
    return prediction.best_mode(_modes(s, d), K)


SHIFTS = (-2, -1, 0, 1, 2)


def _pairs(s, d) -> DataFrame:
    """(field, axis, shift, sad): neighbouring views along each axis, the second rolled by each shift."""
    views, cells = light_fields(s, d), F.sequence(F.lit(0), F.lit(63))

    def error(axis: str, shift: int):
        x, y = (lambda i: i % 8), (lambda i: F.shiftright(i, 3))
        there = (lambda i: F.pmod(x(i) + shift, F.lit(8)) + 8 * y(i)) if axis == "x" else (lambda i: x(i) + 8 * F.pmod(y(i) + shift, F.lit(8)))
        terms = F.transform(cells, lambda i: F.abs(F.get("v", i) - F.get("o", there(i).cast("int"))))
        return F.struct(F.lit(shift).alias("shift"), F.aggregate(terms, F.lit(0).cast("long"), lambda t, e: t + e).alias("sad"))

    out = []
    for axis, along, other in (("x", "a", "b"), ("y", "b", "a")):
        after = views.select("field", (F.col(along) - 1).alias(along), other, F.col("v").alias("o"))
        both = views.join(after, ["field", "a", "b"])
        out.append(both.select("field", F.lit(axis).alias("axis"), F.inline(F.array(*(error(axis, n) for n in SHIFTS)))))
    return out[0].unionAll(out[1]).groupBy("field", "axis", "shift").agg(F.sum("sad").alias("sad"))


def sad_views(s, d):
    return _pairs(s, d)


def best_shift_grid(s, d):
    """The shift of least error along each axis over the whole grid of shifts; of equal ones the smallest."""
    best = _pairs(s, d).groupBy("field", "axis").agg(F.min(F.struct("sad", "shift")).alias("m"))
    return best.select("field", "axis", "m.shift", "m.sad")


def shift_image(s, d):
    """Each view rolled by its distance from the middle view, to the other side along y."""
    cells = light_fields(s, d).select("field", "a", "b", F.posexplode("v").alias("i", "v"))
    cells = blocks.shaped(cells, XY)
    x = prediction.shifted(F.col("x"), prediction.shift_of_view(F.col("a"), SIDE, 1), 8)
    y = prediction.shifted(F.col("y"), prediction.shift_of_view(F.col("b"), SIDE, -1), 8)
    return cells.select("field", "a", "b", x.alias("x"), y.alias("y"), "v")


def psnr(s, d):
    p = pixels(s, d).select("r", (F.col("r") + F.col("b") % 3 - 1).alias("o"))
    mse = F.sum((F.col("r") - F.col("o")) * (F.col("r") - F.col("o"))) / F.count("*")
    return p.agg(F.round(mse, 6).alias("mse"), F.round(statistics.psnr(mse), 6).alias("psnr"), F.round(statistics.bits_per_pixel(F.sum("r"), F.count("*")), 6).alias("bpp"))


def view_uniformity(s, d):
    return statistics.uniform(block(s, d).groupBy("vec_id").agg(F.max("x").alias("w"), F.max("y").alias("h")), "w", "h")


def base_tables(s, d):
    return tables.base_tables(s)


def quality_scale(s, d):
    scaled = (blocks.clamped(color.quality_scaled(F.col("q"), q), 1, 255).cast("int").alias(f"q{q}") for q in (10, 50, 90))
    return tables.base_tables(s).select("name", "x", "y", *scaled)


def table_nearest(s, d):
    """Each block as a table of 8 by 8 entries, made 11 by 6."""
    return tables.scaled_nearest(block(s, d), {"x": (8, 11), "y": (8, 6)}).select("vec_id", "x", "y", "v")


def table_by_dct(s, d):
    """Base tables made 11 by 6 by their coefficients."""
    return tables.scaled_by_dct(tables.base_tables(s), ["name"], {"x": (8, 11), "y": (8, 6)}, "q")


def table_bytes(s, d):
    """Blocks as tables of one byte an entry and of the bytes that an index into 300 places needs."""
    q = F.transform("embedding", lambda e: F.pmod(F.round(e.cast("double") * 256).cast("int"), F.lit(256)))
    wide = tables.entry_bytes(300)
    packed = table(s, d, "embeddings").select("vec_id", tables.packed(q).alias("one"), tables.packed(q, wide).alias("two"))
    back = (tables.unpacked(F.col(n), w) for n, w in (("one", 1), ("two", wide)))
    one, two = back
    return packed.select("vec_id", F.hex("one").alias("data"), F.octet_length("two").alias("n_bytes"), (one == two).alias("same"))


def traversal_quant(s, d):
    cells = scans.traversal(tables.base_tables(s), ["name"], -F.col("q"), F.col("x") + 8 * F.col("y"))
    return cells.select("name", "x", "y", "rank")


def traversal_diagonals(s, d):
    return _traversal(s, d, -scans.diagonal(["x", "y"]))


def tile_pad_2d(s, d):
    return blocks.tiles(block(s, d), XY, {"x": 3, "y": 5})


def tile_crop_4d(s, d):
    step = {"x": 3, "y": 3, "u": 2, "w": 3}
    return blocks.joined_tiles(blocks.tiles(block4(s, d), XYUW, step), XYUW, step).select("vec_id", *XYUW, "v")


def _odd(s, d) -> DataFrame:
    return tables.scaled_nearest(block(s, d), {"x": (8, 9), "y": (8, 9)})


def dwt53_odd(s, d):
    """Blocks of odd lengths: one more low-pass sample than high-pass samples."""
    return transforms.dwt53(_odd(s, d), K, {"x": 9, "y": 9}).select("vec_id", "x", "y", "v")


def dwt53_odd_roundtrip(s, d):
    sizes = {"x": 9, "y": 9}
    back = transforms.idwt53(transforms.dwt53(_odd(s, d), K, sizes), K, sizes)
    return back.select("vec_id", "x", "y", "v")


def golomb_codes(s, d):
    """Levels in scan order as exponential Golomb codes, unary codes with an escape, and Rice codes."""
    a = F.abs("v")
    return scanned(s, d).select(
        "vec_id", "rank", binarization.exp_golomb(a, 0).alias("eg0"), binarization.exp_golomb(a, 2).alias("eg2"),
        binarization.ueg0(a, 3).alias("ueg0"), binarization.rice(a, F.lit(2)).alias("rice2"),
    )


def golomb_values(s, d):
    """Levels read back from their codes."""
    b = binarization
    codes = golomb_codes(s, d)
    return codes.select("vec_id", "rank", b.exp_golomb_value(F.col("eg0"), 0).alias("eg0"), b.exp_golomb_value(F.col("eg2"), 2).alias("eg2"), b.ueg0_value(F.col("ueg0"), 3).alias("ueg0"))


def adaptive_rice(s, d):
    """Rice codes whose parameter follows the levels of a block."""
    levels = F.transform("embedding", lambda e: F.abs(F.shiftright(F.round(e.cast("double") * 256).cast("int"), 4)))
    codes = binarization.adaptive_rice(levels)
    return table(s, d, "embeddings").select("vec_id", F.posexplode(codes).alias("i", "code"))


def diag_average(s, d):
    b = statistics.table_diagonal_average(block(s, d), K, F.col("x") + F.col("y"), "v")
    return b.select("vec_id", "x", "y", F.round("average", 6).alias("average"))


def table_copy(s, d):
    """A one-dimensional table spread over two dimensions."""
    line = signal(s, d).withColumnRenamed("i", "x")
    return line.select("vec_id", "x", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"), "v")


def run_length(s, d):
    r = sequences.run_lengths(scanned(s, d), K, "rank")
    return r.select("vec_id", "rank", "zeroes", "amplitude", sequences.packed_symbol(F.col("zeroes"), F.col("amplitude"), 4).alias("symbol"))


def symbol_weights(s, d):
    return statistics.symbol_weights(sequence(s, d), ["user_id"], "symbol")


def bucket_bounds(s, d):
    return statistics.bucket_bounds(symbol_weights(s, d), ["user_id"], "symbol")


def suffix_types(s, d):
    return sequences.suffix_types(sequence(s, d), ["user_id"], "ord", "symbol").select("user_id", "ord", "symbol", "type", "lms")


def mtf_base(s, d):
    return coding.move_to_front(sequence(s, d).select("user_id", "ord", "symbol"), ["user_id"], "ord", "symbol")


def mtf_rules(s, d):
    """Sequences coded and read back under each update rule."""
    rows = sequence(s, d).select("user_id", "ord", "symbol")
    out = None
    for rule in coding.RULES:
        there = coding.move_to_front(rows, ["user_id"], "ord", "symbol", rule)
        back = coding.move_from_front(there, ["user_id"], "ord", "place", rule).withColumn("rule", F.lit(rule))
        out = back if out is None else out.unionAll(back)
    return out.select("user_id", "rule", "ord", "symbol")


def bwt_short(s, d):
    return sequences.rotations(table(s, d, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "last", "primary")


def bwt_inverse(s, d):
    return bwt_short(s, d).select("p_partkey", sequences.restored(F.col("last"), F.col("primary")).alias("p_name"))


def suffix_array(s, d):
    return sequences.suffix_array(table(s, d, "part").select("p_partkey", "p_name"), ["p_partkey"], "p_name")


def _lengths(s, d) -> DataFrame:
    w = symbol_weights(s, d)
    n = F.count("*").over(Window.partitionBy("user_id"))
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("weight"), "symbol"))
    return w.withColumn("length", F.least(r, n - 1)).select("user_id", "symbol", F.col("length").cast("int").alias("length"))


def canonical_codes(s, d):
    return sequences.canonical_codes(_lengths(s, d).where("length > 0"), ["user_id"], "symbol")


def file_mask(s, d):
    n = table(s, d, "nation").select("n_nationkey")
    return n.select("n_nationkey", filled_mask("view_##/part_#.ppm", F.col("n_nationkey")).alias("name"))


def arith_roundtrip(s, d):
    return coding.coded_blocks(scanned(s, d), K)


def huffman_cost(s, d):
    return coding.huffman_lengths(symbol_weights(s, d), ["user_id"], "symbol")


def lossless_2d(s, d):
    """The whole wavelet path there and back: samples that differ (none)."""
    return coding.wavelet_roundtrip(block(s, d), K, XY)


def arith_wrong(s, d):
    """Levels that the arithmetic coder does not give back."""
    return arith_roundtrip(s, d).select("vec_id", "wrong")


def lossless_wrong(s, d):
    return lossless_2d(s, d).select("vec_id", "wrong")


def _coloured(df: DataFrame) -> DataFrame:
    """Samples of signals as colours."""
    v = F.col("v")
    parts = (v.bitwiseAND(255).alias("r"), F.shiftright(v, 2).bitwiseAND(255).alias("g"), (3 * v).bitwiseAND(255).alias("b"))
    return df.select(*(c for c in df.columns if c != "v"), *parts)


def _recoded(px: DataFrame, sizes: dict[str, int], step: dict[str, int]) -> DataFrame:
    files = codec.encoded(px, K, sizes, step)
    head = containers.Header(f"{len(sizes)}D", tuple(sizes.values()), tuple(step.values()), 8, 0, False)
    return codec.decoded(files, K, head)


def image_codec(s, d):
    """Each embedding as a colour image, coded into a file without loss and decoded; blocks of 3 by 5 don't divide it."""
    return _recoded(_coloured(block(s, d)), XY, {"x": 3, "y": 5})


def image_codec_4d(s, d):
    """Each embedding as a light field of 2 by 2 views, coded and decoded."""
    return _recoded(_coloured(block4(s, d)), XYUW, {"x": 3, "y": 4, "u": 2, "w": 2})


NAMES = (
    "ycbcr_fwd ycbcr_inv ycocg_fwd ycocg_inv rct_fwd rct_roundtrip bit_depth quant_dct quant_dwt tile_pad tile_crop block_grid linear_index "
    "view_address dct_8x8 idct_8x8 dct_4d dct_energy dwt53_block idwt53_block dwt53_roundtrip diag_scan coding_order zigzag_2d traversal_by_ref "
    "traversal_radius traversal_hyperboloid diag_occupancy last_diag neighbour_ctx zero_balance coef_symbols diag_flags lowpass_121 dc_predict planar directional residual sse best_mode "
    "sad_views best_shift_grid shift_image psnr view_uniformity quality_scale diag_average table_copy run_length symbol_weights bucket_bounds "
    "suffix_types mtf_base mtf_rules bwt_short bwt_inverse suffix_array base_tables table_nearest table_by_dct table_bytes traversal_quant traversal_diagonals "
    "tile_pad_2d tile_crop_4d dwt53_odd dwt53_odd_roundtrip golomb_codes golomb_values adaptive_rice canonical_codes file_mask arith_roundtrip huffman_cost lossless_2d arith_wrong lossless_wrong image_codec image_codec_4d"
).split()


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}
