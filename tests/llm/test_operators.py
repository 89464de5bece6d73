"""Edge cases and brute force for the operators on text."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("mosaiq.llm")
from pyspark.sql import functions as F  # noqa: E402

from mosaiq.llm import decontaminate, licenses, lines, ngrams, pieces, quality, sharding, tokens, toxicity, urls  # noqa: E402

DOCS = "doc_id long, text string, n_words string, host string, score string, kept string, comp string"
WORDS = [f"w{k}" for k in range(400)]


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null and empty texts, a null id, repeated rows, a very long text, clashing columns."""
    texts = [None, "", "   \n\t", "one", passage(1, 80), passage(1, 80), passage(2, 20000), "ä ö\n" * 3]
    rows = [(k, t, "x", "x", "x", "x", "x") for k, t in enumerate(texts)]
    return [*rows, rows[4], (None, passage(3, 30), "x", "x", "x", "x", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    """Components by brute force over all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(s), top(i)) for i, s in sets}


def near_copies(groups=8, size=7, seed=5):
    r, rows = random.Random(seed), []
    for g in range(groups):
        base = passage(100 + g, r.choice([3, 6, 30, 90, 300])).split()
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
    return rows


def joined(spark, rows):
    out = ngrams.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}


def test_join_is_brute_force(spark):
    rows = near_copies()
    assert joined(spark, rows) == classes(rows)


def test_join_in_families(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "CROWD", 3)
    monkeypatch.setattr(ngrams, "BLOCK", 500)
    rows = near_copies(4, 14, 9)
    assert joined(spark, rows) == classes(rows)


def test_guarantee_of_signatures():
    """Sets that reach the similarity share an active key, whatever shares least is dropped."""
    r = random.Random(3)
    for _ in range(300):
        n = r.choice([1, 2, 5, 20, 63, 64, 100, 200, 500])
        a = {r.getrandbits(64) for _ in range(n)}
        b = set(a)
        while True:
            c = set(b)
            c.discard(r.choice(sorted(c))) if r.random() < 0.5 and len(c) > 1 else c.add(r.getrandbits(64))
            if 4 * len(a & c) < 3 * len(a | c):
                break
            b = c
            if r.random() < 0.02:
                break
        small, large = sorted((a, b), key=len)
        band = len(large).bit_length() - 1
        x = ngrams.signatures(np.array(sorted(small), dtype=np.uint64), band)
        y = ngrams.signatures(np.array(sorted(large), dtype=np.uint64), band)
        plain = set(x[0][x[1] == 0].tolist())
        agree = len(plain & set(y[0][y[1] == 0].tolist()))
        if x[2] >= 0:
            assert agree > x[2]
        else:
            assert x[2] + x[3] >= 0 and set(x[0].tolist()) & set(y[0].tolist())


def test_guarantee_of_doubled_segments(spark, monkeypatch):
    """A set that counts variants and drops its most shared key meets a set that only one segment,
    with variants and shared by a crowd, has in common with it."""
    m, band = 32, 6
    monkeypatch.setattr(ngrams, "plan", lambda b: (m, 2))
    r, dealt = random.Random(8), defaultdict(list)
    with np.errstate(over="ignore"):
        seed = np.uint64((band + 1) * int(ngrams._M2) % (1 << 64))
        for x in np.array([r.getrandbits(64) for _ in range(4000)], dtype=np.uint64):
            dealt[(int(ngrams.mix(x + seed)) >> 32) * m >> 32].append(int(x))
    new = lambda k: dealt[k].pop()
    a = {k: [new(k) for _ in range(7 if k == 5 else 3)] for k in range(m)}
    b = {k: x[1:] if k in (2, 3, 4) else x if k == 0 else x + [new(k) for _ in range(2 if k == 1 else 1)] for k, x in a.items()}
    crowd = [{k: a[0] if k == 0 else [new(k) for _ in range(3)] for k in range(m)} for _ in range(3)]
    sets = [np.array(sorted(sum(x.values(), [])), dtype=np.uint64) for x in (a, b, *crowd)]
    one, other = set(sets[0].tolist()), set(sets[1].tolist())
    assert 4 * len(one & other) >= 3 * len(one | other) and len(one) == 100
    spare, doubled = ngrams.signatures(sets[0], band)[2:4]
    assert (spare, doubled) == (-1, 2)

    class Local:
        """Runs the function on the driver, over the sets above for texts."""

        columns = ["doc_id", "text"]
        where = select = lambda self, *_: self

        def mapInArrow(self, run, schema):
            import pyarrow as pa

            part = pa.RecordBatch.from_pydict({"doc_id": list(range(len(sets))), "text": [str(k) for k in range(len(sets))]})
            return spark.createDataFrame([x for y in run([part]) for x in map(lambda z: tuple(z.values()), y.to_pylist())], schema)

    monkeypatch.setattr(ngrams, "shingle_set", lambda text: sets[int(text)])
    rows = ngrams._allocated(ngrams._shared(ngrams.filed(Local())))
    pairs = ngrams._pairs(rows.withColumn("comp", F.col("sid")).withColumn("unit", F.col("sid"))).collect()
    assert tuple(sorted(map(ngrams.set_id, sets[:2]))) in {(x["a"], x["b"]) for x in pairs}


def test_short_sets_take_the_second_pass(spark, monkeypatch):
    whole = ngrams.signatures
    monkeypatch.setattr(ngrams, "filed_short", lambda shared: shared.where("not member").select("sid").distinct())
    rows = near_copies(3, 5, 2)
    assert joined(spark, rows) == classes(rows) and whole


def test_family_and_component_of_one_id(spark, monkeypatch):
    """Set 1 leads a large family and gives its component its id; 3 is of that component only,
    4 of the family only, and the link of 3 and 4 joins the components."""
    monkeypatch.setattr(ngrams, "CROWD", 2)
    sets = {k + 1: np.arange(12 * k, 12 * k + 100, dtype=np.uint64) for k in range(4)}
    weight, keys = {1: 9.0, 2: 8.0, 3: 2.0, 4: 1.0}, {10: (1, 2), 11: (1, 4), 12: (1, 4), 13: (2, 3), 14: (3, 4)}
    rows = [(key, i, 100, 6, False, False, True, weight[i]) for key, held in keys.items() for i in held]
    rows = spark.createDataFrame(rows, "key long, sid long, n int, band int, deleted boolean, visitor boolean, active boolean, weight double")
    known = spark.createDataFrame([(i, 100, ngrams.parities(ngrams.mix(s)).tolist()) for i, s in sets.items()], "sid long, n int, parities array<long>")
    whole = spark.createDataFrame([(i, s.tolist()) for i, s in sets.items()], "sid long, s array<long>")
    found = ngrams.links(ngrams.stash(rows, "test-rows"), lambda pairs: ngrams.stash(whole, "test-sets"), known)
    assert {tuple(sorted((r["a"], r["b"]))) for r in found.collect()} == {(1, 2), (2, 3), (3, 4)}


def test_join_odd(odd, none):
    out = ngrams.joined(odd).collect()
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert len(out) == 10 and by[0] == by[1].copy()[:0] + [(0, 0)] and by[1] == [(0, 1)] and by[3] == [(1, 3)]
    assert by[5][0][1] == 4 and len(by[4]) == 2 and by[None][0][1] is None
    assert ngrams.joined(none).count() == 0
    assert ngrams.one_of_each(odd).where("doc_id in (4, 5)").count() == 1


def test_quality_odd(odd, none):
    out = {(r["doc_id"], r["n_words"]): r for r in quality.judged(odd).collect()}
    assert out[(0, 0)]["base_failed"] and not out[(0, 0)]["kept"] and out[(4, 80)]["kept"]
    assert out[(7, 6)]["n_dup_lines"] == 2 and quality.judged(none).count() == 0


def test_quality_repeats(spark):
    text = "a b c d e f g a b c d e x y z"
    r = quality.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["n_repeat_words"] == 10


def test_quality_order(spark):
    """Cheap and rejecting rules go first, each judged on what is left; the order is the same in
    every run and never changes the verdict."""
    r = random.Random(4)
    rows = [(k, passage(k, 30) + (" " + "#" * 27 if r.random() < 0.5 else "") + ("".join(f"\n- {j} x" for j in range(60)) if r.random() < 0.2 else "")) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = quality.default_rules()
    names = [[x.name for x in quality.ordered(quality.measured(quality.sampled(docs, 100)), rules)] for _ in range(3)]
    assert names[0] == names[1] == names[2] and names[0][0] == "symbols" and names[0].index("letters") > names[0].index("word_length")
    want = {x["doc_id"]: x["kept"] for x in quality.judged(docs, rules).collect()}
    for other in (rules[::-1], rules[3:] + rules[:3]):
        kept = quality.measured(docs)
        verdict = F.when(F.col("base_failed"), F.lit(False))
        for rule in other:
            verdict = verdict.when(rule.rejects, F.lit(False))
        assert {x["doc_id"]: x["kept"] for x in kept.withColumn("kept", verdict.otherwise(F.lit(True))).collect()} == want


def test_token_limits_and_quantiles(spark):
    """Rows for limits that no document has, and the lengths that are quantiles."""
    hist = spark.createDataFrame([(3, 5), (7, 4), (2000, 1)], "n_tokens long, n_docs long")
    out = {r["n_tokens"]: r for r in tokens.with_quantiles(tokens.with_sums(tokens.with_limits(hist, [5, 7, 4096])), [0.5, 0.6, 1.0]).collect()}
    lengths = [3] * 5 + [7] * 4 + [2000]
    assert {k: r["truncated_total"] for k, r in out.items()} == {k: sum(min(x, k) for x in lengths) for k in (3, 5, 7, 2000, 4096)}
    assert {k: list(r["quantile_of"]) for k, r in out.items()} == {3: [0.5], 5: [], 7: [0.6], 2000: [1.0], 4096: []}
    assert tokens.with_limits(hist.limit(0)).count() == 0


def test_token_histogram(spark, odd, none):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = [len(enc.encode_ordinary(r[1])) if r[1] else 0 for r in odd_rows()]
    sums = tokens.with_sums(tokens.histogram(odd)).cache()
    for r in sums.collect():
        assert r["n_docs"] == lengths.count(r["n_tokens"])
        assert r["docs_over"] == sum(x > r["n_tokens"] for x in lengths)
        assert r["tokens_within"] == sum(x for x in lengths if x <= r["n_tokens"])
        assert r["truncated_total"] == sum(min(x, r["n_tokens"]) for x in lengths)
    limits = {r["limit"]: r["total"] for r in tokens.truncated_totals(sums, [5, 100, 10**6]).collect()}
    assert limits == {m: sum(min(x, m) for x in lengths) for m in (5, 100, 10**6)}
    assert tokens.quantiles(sums, [0.5]).first()["n_tokens"] == sorted(lengths)[len(lengths) // 2 - 1]
    assert tokens.with_sums(tokens.histogram(none)).count() == 0


def brute_lines(rows):
    key = lambda x: x.encode().strip(lines._SPACES).lower().decode()
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = {}
    for i, t in rows:
        every = (t or "").split("\n")
        stay = [x for x in every if key(x) not in gone or gone[key(x)] == i]
        out[i] = (len(every), len(every) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


def test_line_dedup(spark):
    shared = ["É" * 40, "Shared line " * 5, "shared LINE " * 5 + "\t", "short", "x" * 39]
    r = random.Random(1)
    rows = [(k, "\n".join(r.choice([*shared, passage(k, 9), passage(r.randrange(4), 12)]) for _ in range(6))) for k in range(40)] + [(99, None), (98, "")]
    out = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x["doc_id"]: (x["n_lines"], x["n_dropped"], hashlib.sha256(x["kept"].encode()).hexdigest()) for x in out.collect()}
    assert got == brute_lines(rows)


def test_line_runs_levels(spark, odd, none):
    """A key is counted until the runs settle it; runs are compacted by levels."""
    store = lines.LineRuns(spark, fanout=2)
    for k in range(5):
        batch = spark.createDataFrame([(20 - k, passage(7, 30)), (10 - k, passage(k, 30))], "doc_id long, text string")
        store.add(lines.line_keys(batch), 3)
    assert [len(x) for x in store.levels] == [1, 0, 1] and store.totals().agg(F.max("n_docs")).first()[0] == 3
    assert store.totals().where("n_docs = 3").first()["last_doc"] == 20 and store.totals().count() == 6
    assert lines.deduplicated(odd).count() == 10 and lines.deduplicated(none).count() == 0


def test_line_dedup_counts_documents(spark, monkeypatch):
    """Five rows of two documents are two documents; both ways to apply the keys agree."""
    common, other = passage(1, 20), passage(2, 20)
    rows = [(1, common)] * 4 + [(2, common)] + [(k, f"{other}\n{k}") for k in (3, 3, 4, 5, 6, 7)] + [(None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([("None", 0)] + [(str(k), 0) for k in (1, 1, 1, 1, 2, 7)] + [(str(k), 1) for k in (3, 3, 4, 5, 6)])
    for most in (lines.MOST_KEYS, 0):
        monkeypatch.setattr(lines, "MOST_KEYS", most)
        assert sorted((str(r["doc_id"]), r["n_dropped"]) for r in lines.deduplicated(docs).collect()) == want


def test_licenses(spark, odd, none):
    whole = licenses.TEMPLATES["mit-grant"]
    near = whole.replace("free of charge", "free of cost").upper()
    rows = [(1, f"{passage(1, 60)} {whole} {passage(2, 60)}"), (2, passage(3, 20) + "\n" + licenses.TEMPLATES["apache-notice"]), (3, passage(4, 90)), (4, near)]
    out = {r["doc_id"]: [x["name"] for x in r["licenses"]] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: ["mit-grant"], 2: ["apache-notice"], 3: [], 4: ["mit-grant"]}
    assert licenses.scanned(odd).where(F.size("licenses") > 0).count() == 0 and licenses.scanned(none).count() == 0


def test_license_bands():
    for n in (5, 12, 30, 200):
        assert licenses.bands_for(n) >= 1


def test_decontamination(spark, odd, none):
    items = [(k, passage(50 + k, 30)) for k in range(6)] + [(7, "only three words"), (8, None), (9, "")]
    near = items[1][1].split()
    near[15] = "other"
    texts = {1: f"{passage(1, 200)} {items[0][1].upper()}. {passage(2, 50)}", 2: passage(3, 300), 3: " ".join(near) + " end", 4: "has Only, three WORDS here", 5: items[2][1][:80]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(docs, bench).collect()}
    # Five of the 26 shingles of item 1 differ: 21 of 31, less than 0.75.
    assert set(out) == {(1, 0), (4, 7)} and out[(1, 0)] == 1.0
    assert decontaminate.without_matches(docs, bench).where("doc_id in (1, 4)").count() == 0
    assert decontaminate.matches(odd, bench).count() == 0 and decontaminate.without_matches(odd, bench).count() == 10
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def plain_matches(docs, items):
    """{(doc_id, item_id): similarity} by brute force over all windows of at least five words."""
    found = {}
    cut = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    for i, text in docs:
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        for j, item in items:
            v = item.lower().split()
            b = cut(v)
            for at in range(max(0, len(w) - len(v)) + 1):
                a = cut(w[at : at + len(v)])
                s = sum((a & b).values()) / max(1, sum((a | b).values()))
                if s >= 0.75:
                    found[i, j] = max(s, found.get((i, j), 0))
    return found


def test_decontamination_finds_near_copies(spark):
    items = [(k, passage(50 + k, 40)) for k in range(4)]
    docs = [(9, passage(3, 200))]
    for k, item in items:
        for at in (0, 1, 20, 38):  # one word changed: 1 to 5 of 36 shingles
            w = item.split()
            w[at] = "other"
            docs.append((100 * k + at + 10, f"{passage(500 + k, 30)} {' '.join(w)} {passage(600 + k, 30)}"))
    want = plain_matches(docs, items)
    out = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) >= 12 and {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in out} == want


def test_decontamination_finds_moved_parts(spark):
    """Copies with their halves swapped, whose windows aren't aligned with any shingle; repeated
    shingles; repeated rows; a copy deep in a very long text."""
    items = [(k, passage(70 + k, 40 + k)) for k in range(6)] + [(9, " ".join(["a b c d e f"] * 8))]
    docs = []
    for k, item in items:
        w = item.split()
        docs.append((k, f"{passage(11 + k, 60)} {' '.join(w[20:] + w[:20])} {passage(31 + k, 60)}"))
        docs.append((20 + k, f"{passage(41 + k, 5)} {' '.join(w[2:] + w[:2])}"))
        docs.append((40 + k, " ".join(w[:-3])))
    docs += [docs[0], (60, f"{passage(5, 30000)} {items[1][1]} {passage(6, 3000)}")]
    want = plain_matches(docs, items)
    out = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) >= 20 and {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in out} == want


def test_decontamination_recall_at_the_radius(spark):
    """Random sets of similarity 0.75: the blocks find nearly all pairs within the radius."""
    r = random.Random(2)
    rows = []
    for k in range(400):
        a = [r.getrandbits(62) for _ in range(42)]
        rows.append((k, a, a[:36] + [r.getrandbits(62) for _ in range(6)]))
    df = spark.createDataFrame(rows, "wid long, a array<long>, b array<long>").withColumn("len", F.lit(46))
    seen = decontaminate._fingerprints(df.select("wid", "len", "a"), "wid")
    known = decontaminate._fingerprints(df.select("wid", "len", F.col("b").alias("a")), "wid")
    filed = decontaminate._filed(known).select(F.col("wid").alias("iid"), "len", "block", "part")
    met = decontaminate._blocked(seen).join(filed, ["len", "block", "part"])
    assert met.where("wid = iid").select("wid").distinct().count() >= 398
    assert met.where("wid <> iid").count() < 400 * 400  # of all pairs less than one row each


def test_decontamination_by_items_of_several_lengths(spark):
    """A text that is a short item, where longer items share a phrase with it."""
    items, docs = [], []
    for k in range(6):
        short = passage(900 + k, 44 + k)
        phrase = " ".join(short.split()[10:16])
        items.append((10 * k, short))
        items += [(10 * k + j, f"{passage(950 + 9 * k + j, 40)} {phrase} {passage(990 + 9 * k + j, 10 * j)}") for j in (1, 2, 3)]
        docs += [(10 * k, short), (10 * k + 1, f"{passage(700 + k, 90)} {short} {passage(800 + k, 90)}")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    out = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in out}
    assert found == {(10 * k + j, 10 * k, 90 * j, 1.0) for k in range(6) for j in (0, 1)}


TEXTS = ["", " ", "a b", "  a  b ", "x" + " " * 37 + "y", "\n\nq\n", "日本 ①", "ab" * 40, "The quick brown fox"]


def test_pieces_match_the_library(spark, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(4)
    signs = " \n\tabcdeéßñ日本x'-.,▁"[:-1]
    texts = TEXTS + ["".join(r.choice(signs) for _ in range(r.randrange(80))) for _ in range(300)]
    enc = pieces.Encoder(pieces.Pieces.load(pieces.MODEL))
    assert enc.encode(texts) == sp.encode(texts)
    out = pieces.decoded(pieces.encoded(odd)).collect()
    assert len(out) == 10 and all(x["decoded"] == (x["text"] or "") for x in out)
    assert pieces.encoded(none).count() == 0


def test_pieces_of_few_new_words(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.Pieces.load(pieces.MODEL)
    # A batch may hold one new word only, shorter than the code points that are compared.
    texts = ["q", "日", "it", "xqz", "lamp", "these", "window", "b\nq", "  q", "\n", " ", ""]
    for t in texts:
        assert pieces.Encoder(model).encode([t]) == [sp.encode(t)], t
    enc = pieces.Encoder(model)
    assert [enc.encode([t])[0] for t in texts] == sp.encode(texts)
    monkeypatch.setattr(pieces, "BATCH", 1)
    monkeypatch.setattr(pieces, "PART", 8)
    monkeypatch.setattr(pieces, "REMEMBERED", 4)
    texts += [passage(k, 1 + k % 9) for k in range(40)]
    assert pieces.Encoder(model).encode(texts) == sp.encode(texts)


def test_sharding(spark, odd, none):
    rows = [(k, passage(k, k % 50)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.sharded(docs, limit=4000).collect()
    held = Counter()
    for r in out:
        held[r["shard"]] += len(r["text"] or "")
    assert len(out) == 600 and all(v <= 4000 for v in held.values())
    names = sorted(held)
    assert all(not b.startswith(a) for a in names for b in names if a != b)
    for r in out:  # a bucket is split only if the one above it was too large
        above = r["shard"][:-1]
        assert sum(v for n, v in held.items() if n.startswith(above)) > 4000
    large = sharding.sharded(odd, limit=1000).where("oversize").collect()
    assert {r["doc_id"] for r in large} == {6} and sharding.sharded(odd, limit=1000).count() == 10
    assert sharding.sharded(none).count() == 0


def test_urls(spark):
    want = {
        "http://A.Example.NET/en/x?q": ("example.net/en/", "allow"), "https://x.net": (None, "allow"), "https://x.net/": ("net/", "block"),
        "http://b.example.com/de/1": ("example.com/de/", "block"), "http://c.org/fr/": ("org/fr/", "allow"), None: (None, "allow"), "nothing": (None, "allow"),
        "http://www.cheap-pills.example.com/en/": (None, "block"), "http://notexample.net/en/": ("net/", "block"), "http://my-casino.de#x": (None, "block"),
    }
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(want)], "page_id long, url string, host string")
    out = {r["url"]: (r["rule"], r["verdict"]) for r in urls.filtered(pages).collect()}
    assert out == want and urls.filtered(pages.limit(0)).count() == 0
    hosts = {r["url"]: (r["host"], r["path"]) for r in urls.filtered(pages).collect()}
    assert hosts["http://A.Example.NET/en/x?q"] == ("a.example.net", "/en/x") and hosts[None] == ("", "") and hosts["https://x.net"] == ("x.net", "")


def test_toxicity(spark, odd, none):
    rows, labels = [], []
    for k in range(300):
        bad = k % 3 == 0
        rows.append((k, passage(k, 60) + (" Grobian Flegel" if bad else "")))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    model = toxicity.learned(docs, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int"))
    out = toxicity.scored(docs, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).where("doc_id < 300 and h").collect()
    assert len(out) > 20 and sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in out) >= 0.95 * len(out)
    empty = toxicity.learned(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(odd, empty).where("predicted = 0").count() == 10 and toxicity.scored(none, model).count() == 0


def test_toxicity_pieces_overlap(monkeypatch):
    text = passage(1, 300)
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "PIECE", 100)
    assert all((a == b).all() for a, b in zip(toxicity.features(text), whole, strict=True))


def test_toxicity_held_out(spark):
    """Held-out recall and false alarms on the driver's tables; scores equal a plain recount."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learned(docs, labels)
    rows = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    out = toxicity.scored(rows, model).select("text", "toxic", "score", "predicted").collect()
    toxic, clean = ([r["predicted"] for r in out if r["toxic"] == k] for k in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    known = {int(k): float(model.weights[k]) for k in np.flatnonzero(model.weights)}
    for r in out[:40]:
        count = Counter(int(p) for part in toxicity.ngram_places(r["text"]) for p in part)
        z = model.bias + sum(w * np.log1p(count[k] * 2000 / max(len(r["text"]), 200)) for k, w in known.items() if k in count)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_toxicity_of_repeated_ids(spark):
    """Of rows that share an id one text trains; every row is scored by its own text."""
    docs = spark.createDataFrame([(2, "a"), (2, "b"), (2, "a"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert sorted((r["doc_id"], r["label"]) for r in toxicity.training_rows(docs, labels).collect()) == [(k, v) for k, v in ((2, 1), (3, 0)) if k in (2, 3)]


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left, ids = docs, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES:
        left = stage(spark, left, sf)
        if name != "sentencepiece":
            assert left.dtypes == docs.dtypes
        now = {r[0] for r in left.select("doc_id").collect()}
        assert now <= ids
        ids = now


def test_pipeline_stages_are_brute_force(spark, tmp_path):
    """Ids and texts that each stage leaves, against plain Python."""
    pipeline = pytest.importorskip("corpus_pipeline")
    import sentencepiece

    common = "This line is in very many of the documents here."
    items = [(k, passage(50 + k, 30 + k)) for k in range(3)]
    rows = []
    for k in range(120):
        body = passage(1000 + k, 60) + (" Grobian Flegel" if k % 3 == 0 else "")
        rows.append((k, f"{body}\n{common}\n{passage(2000 + k, 20)}" if k % 4 == 1 else body))
    rows += [(200 + k, rows[3 * k + 1][1] + " end") for k in range(8)]
    rows += [(300 + k, f"{passage(3000 + k, 50)} {items[k][1]} {passage(4000 + k, 50)}") for k in range(3)]
    rows += [(400, None), (401, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def toxic(left):
        model = toxicity.learned(docs, marks)
        return {i: t for i, t in left.items() if model.score(t) < 0.5}

    def deduplicated(left):
        held = defaultdict(set)
        for i, t in left.items():
            for x in (t or "").split("\n"):
                held[x.strip().lower()].add(i)
        gone = {x: max(v) for x, v in held.items() if len(x) >= 40 and len(v) >= 5}
        stay = lambda i, x: gone.get(x.strip().lower(), i) == i
        return {i: t and "\n".join(x for x in t.split("\n") if stay(i, x)) for i, t in left.items()}

    def one_of_each(left):
        comp = classes(sorted(left.items()))
        return {i: t for i, t in left.items() if comp[i][1] == i}

    def clean(left):
        bad = {i for i, _ in plain_matches(left.items(), items)}
        return {i: t for i, t in left.items() if i not in bad}

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain = {"toxicity": toxic, "line_dedup": deduplicated, "ngram_join": one_of_each, "decontamination": clean}
    assert [name for name, _ in pipeline.STAGES] == [*plain, "sentencepiece"]
    left, want = docs, dict(rows)
    for name, stage in pipeline.STAGES:
        left = stage(spark, left, str(tmp_path)).cache()
        got = left.collect()
        if name == "sentencepiece":
            assert len(got) == len(want) and {r["doc_id"]: (list(r["ids"]), r["n_tokens"]) for r in got} == {i: (x := library.encode(t or ""), len(x)) for i, t in want.items()}
            continue
        before, want = want, plain[name](want)
        assert want and want != before, name
        assert len(got) == len(want) and {r["doc_id"]: r["text"] for r in got} == want, name
        assert all(r["n_chars"] == len(r["text"] or "") for r in got)


def test_parities_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(1)
    for n in (1, 40, 63, 64, 127, 128, 500, 1023, 1024, 5000):
        for share in (0, 0.05, 0.3):
            a, k = rng.integers(0, 2**63, n, dtype=np.uint64), int(n * share)
            b = np.unique(np.r_[a[k:], rng.integers(0, 2**63, 2 * k, dtype=np.uint64)])
            x, y = sorted((ngrams.parities(np.unique(a)), ngrams.parities(b)), key=len)
            if len(y) > len(x):
                y = y[: len(x)] ^ y[len(x) :]
            bits = sum((int(v) & (2**64 - 1)).bit_count() for v in x ^ y)
            assert bits <= len(np.setxor1d(a, b))


def test_url_rules_as_a_table(spark, monkeypatch):
    """Both ways of filing rules give what running every rule on every URL gives."""
    r = random.Random(9)
    hosts = ["a.net", "www.a.net", "b.net", "x.org", "spam-farm.com", "c.example.com", "net", "EXAMPLE.net", "other.com"]
    found = [f"http://{r.choice(hosts)}/{r.choice(['en/', 'de/', 'fr/', ''])}{k}?q=://z" for k in range(60)]
    found += [found[0], found[0], None, "", "no scheme", "http://", "http://a.net", "http://b.net/" + "en/" * 5000]
    rules = [*urls.default_rules(), urls.UrlRule("digit", "block", "[0-9]$", ()), urls.host_rule("a.net/en/", "block"), urls.host_rule("b.net/en/", "allow")]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(found)], "page_id long, url string, host string, verdict string")

    def judged(u):
        place = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            place = host.lower() + re.match("[^?#]*", rest[len(host) :])[0]
        hits = [x for x in rules if re.search(x.pattern, place)]
        top = max(hits, key=lambda x: (x.listed, len(x.name), x.name), default=None)
        return (top.name if top and top.listed else None, top.verdict if top else "allow")

    want = sorted((k, *judged(u)) for k, u in enumerate(found))
    want = sorted(want, key=repr)
    rows = lambda df: sorted(((x["page_id"], x["rule"], x["verdict"]) for x in df.collect()), key=repr)
    assert rows(urls.filtered(pages, rules)) == want
    monkeypatch.setattr(urls, "MOST_RULES", 3)
    table = urls.filtered(pages, rules)
    assert rows(table) == want and sorted(table.columns) == sorted([*pages.columns, "path", "rule"])
    assert urls.filtered(pages.limit(0), rules).count() == 0
    empty = urls.filtered(pages, urls.rule_table(spark, []))
    assert {(x["rule"], x["verdict"]) for x in empty.collect()} == {(None, "allow")}
