"""Signal queries against DuckDB, and coders by round trip."""

import random
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from mosaiq.__main__ import main
from mosaiq.functions import codec, coding, masks
from mosaiq.operators import prediction, tables
from mosaiq.plans import oracles, queries
from mosaiq.sources import containers, ppm

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in queries.NAMES if n in oracles.SQL])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, SF)
    got = con.execute(oracles.SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    rows = df.select(*(f"`{n}`" for n in names)).collect()
    assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == sorted((tuple(map(plain, r)) for r in got.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["arith_roundtrip", "lossless_2d"])
def test_nothing_is_lost(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.count() == 500 and df.where("wrong > 0").count() == 0


def test_huffman_is_complete(spark):
    rows = queries.queries()["huffman_cost"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r["user_id"], []).append(r["length"])
    assert all(sum(2.0**-x for x in v) == 1 for v in by.values() if len(v) > 1)


def test_levels_come_back():
    r = random.Random(1)
    for _ in range(200):
        levels = [int(r.gauss(0, r.choice([0.3, 2, 20]))) for _ in range(r.randrange(100))]
        assert coding.decode_levels(coding.encode_levels(levels), len(levels)) == levels


def test_directions():
    assert len(prediction.directions(2)) == 11 and len(prediction.directions(4)) == 479


def test_masks():
    assert masks.file_names("a#b#")[12] == "a1b2" and len(masks.file_names("x##")) == 100 and masks.file_names("x") == ["x"]


@pytest.mark.parametrize("top", [255, 256, 65535])
def test_ppm_comes_back(spark, tmp_path, top):
    r = random.Random(top)
    samples = [r.randrange(top + 1) for _ in range(3 * 5 * 4)]
    (tmp_path / "a.ppm").write_bytes(ppm.packed(5, 4, top, samples))
    (tmp_path / "b.ppm").write_bytes(b"P6 # note\n5\t4 # more\n%d\n" % top + ppm.packed(5, 4, top, samples).split(b"\n", 3)[3])
    df = ppm.images(spark, f"{tmp_path}/*.ppm")
    assert df.count() == 2 and {(x["width"], x["height"], x["maxval"]) for x in df.collect()} == {(5, 4, top)}
    px = ppm.pixels(df).where("path like '%a.ppm'").orderBy("y", "x").collect()
    assert [c for x in px for c in (x["r"], x["g"], x["b"])] == samples
    ppm.write(ppm.pixels(df), 5, 4, top, f"{tmp_path}/out")
    again = ppm.images(spark, f"{tmp_path}/out/*.ppm")
    assert sorted(x["data"] for x in again.collect()) == sorted(x["data"] for x in df.collect())


def test_ppm_rejects():
    for bad in (b"P5\n1 1\n255\n\0", b"P6\n0 1\n255\n\0", b"P6\n1 1\n70000\n\0", b"P6\n1 1\n255\n"):
        assert ppm.header(bad) is None


def test_container():
    h = containers.Header("4D", (9, 8, 3, 3), (3, 3, 3, 3), 8, 2, True, (-4, 7))
    data = containers.packed(h, b"xyz")
    assert containers.parsed(data) == (h, b"xyz")
    with pytest.raises(ValueError):
        containers.parsed(b"other")


@pytest.mark.parametrize("rule", list(coding.RULES))
def test_rules_come_back(rule):
    r = random.Random(2)
    for _ in range(50):
        symbols = [r.randrange(r.choice([2, 9])) for _ in range(r.randrange(60))]
        assert coding.symbols_of(coding.places_of(symbols, coding.RULES[rule]()), coding.RULES[rule]()) == symbols


def test_rules_by_hand():
    places = {rule: coding.places_of([2, 2, 1, 2], coding.RULES[rule]()) for rule in coding.RULES}
    assert places == {
        "front": [2, 0, 2, 1], "m1ff": [2, 1, 2, 0], "m1ff2": [2, 1, 2, 0],
        "sticky": [2, 1, 2, 2], "steps": [2, 0, 2, 1], "count": [2, 2, 1, 2],
    }


def test_entry_bytes():
    assert [tables.entry_bytes(n) for n in (1, 256, 257, 65536, 65537, 2**32 + 1)] == [1, 1, 2, 2, 4, 8]


def test_transforms_shuffle_once(spark):
    for name in ("dwt53_block", "dct_4d", "lowpass_121", "idwt53_block"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 1, name


def test_queries_without_the_subpackage():
    source = Path(queries.__file__).parents[2] / "__spark_entry__.py"
    code = "import sys, importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if 'llm' in n else f(n, *a); import __spark_entry__ as e; print(any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=source.parent, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["False", "False"]


@pytest.mark.parametrize("discarded", [0, 2])
def test_commands(spark, tmp_path, discarded):
    r = random.Random(discarded)
    sizes, top = (19, 13), 255
    made = {f"{n}.ppm": [min(top, max(0, int(r.gauss(90 + 2 * i, 30)))) for i in range(3)] * (sizes[0] * sizes[1]) for n in "ab"}
    made["b.ppm"] = [r.randrange(top + 1) for _ in made["b.ppm"]]
    for name, samples in made.items():
        (tmp_path / name).write_bytes(ppm.packed(*sizes, top, samples))
    assert main(["compress", "-i", f"{tmp_path}/*.ppm", "-o", f"{tmp_path}/coded", "-d", str(discarded)]) == 0
    assert sorted(p.name for p in (tmp_path / "coded").iterdir()) == ["a.lfif", "b.lfif"]
    assert main(["decompress", "-i", f"{tmp_path}/coded/*.lfif", "-o", f"{tmp_path}/back"]) == 0
    for name, samples in made.items():
        back = (tmp_path / "back" / name).read_bytes()
        w, h, maxval, at = ppm.header(back)
        assert (w, h, maxval) == (*sizes, top)
        off = max(abs(a - b) for a, b in zip(back[at:], samples, strict=True))
        assert off == 0 if discarded == 0 else 0 < off < 64


def test_commands_refuse(spark, tmp_path):
    (tmp_path / "a.ppm").write_bytes(ppm.packed(2, 1, 255, range(6)))
    (tmp_path / "b.ppm").write_bytes(ppm.packed(1, 2, 255, range(6)))
    (tmp_path / "c.lfif").write_bytes(b"something else")
    assert main(["compress", "-i", f"{tmp_path}/*.ppm", "-o", f"{tmp_path}/out"]) == 1
    assert main(["compress", "-i", f"{tmp_path}/*.none", "-o", f"{tmp_path}/out"]) == 1
    assert main(["decompress", "-i", f"{tmp_path}/*.lfif", "-o", f"{tmp_path}/out"]) == 1
    assert main(["compress", "-i", "x"]) == 2 and not (tmp_path / "out").exists()


def test_images_that_lack_pixels(spark):
    px = spark.createDataFrame([(1, 0, 0, 1, 2, 3)], "k int, x int, y int, r int, g int, b int")
    with pytest.raises(Exception, match="levels"):
        codec.encoded(px, ["k"], {"x": 2, "y": 1}, {"x": 2, "y": 1}).collect()
    assert codec.header_of(codec.encoded(px.limit(0), ["k"], {"x": 2, "y": 1}, {"x": 2, "y": 1})) is None
