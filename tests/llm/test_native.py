"""URL filter, personal data, secrets and mixing: brute force and odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import common, mixing, pii, secrets, spans, url_filter

SF = "/root/testdata/sf0.001"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_prefix_sums(spark):
    rng = random.Random(1)
    cases = [[rng.randint(0, 9) for _ in range(n)] for n in (1, 2, 127, 128, 129, 1000)]
    got = spark.createDataFrame([(c,) for c in cases], "x array<bigint>").select("x", spans.starts(F.col("x")).alias("s")).collect()
    for r in got:
        assert r["s"][: len(r["x"])] == [sum(r["x"][:k]) for k in range(len(r["x"]))]


def luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def figures(s):
    return re.sub("[^0-9]", "", s)


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(figures(m[0])) <= 19 and luhn(figures(m[0]))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(figures(m[0])) <= 15)]
SECRETS = [("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]


def expected(patterns, text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(patterns) for m in re.finditer(p, text or "") if ok(m)]
    return ",".join(f"{patterns[k][0]}:{a}:{b}" for a, k, b in sorted(found))


ODD = ["", None, "a@b.c_d@e.f x@y", "\x01a@b.co\x01 \U0001f600 é 1.2.3.4.5 256.1.1.1 0255.1.1.1", "a@" * 50 + "b.c", "4111 1111 1111 1111 4111-1111-1111-1112 +1 (017) 555-7713.", "9" * 5000, "1.1.1.1" * 300, "+1 ++12345678901 +123 456 789 0 1", "x" * 3000 + "@d.e" + "-._%+" * 100]
LEAKS = ["token = abcdef Password:'x12345 api_key=short secret==123456", "AKIA" * 6 + "0" * 10, "0123456789abcdef" * 3 + "G", "tokentoken: \u212aTOKEN=aaaaaaa", "a" * 23, "b" * 24, "ſecret=1234567"]


def random_texts(alphabet, n=300):
    rng = random.Random(5)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("module,patterns,odd", [(pii, PII, ODD + random_texts(list("0123456789") * 2 + list("..@@+ -()ab_é\x01"))), (secrets, SECRETS, LEAKS + ODD[:3] + random_texts(["token", "SECRET", "=", ":", " ", "'", "abc", "0f", "AKIA", "ZZZZZZ9", "é", "."]))])
def test_base_spans(spark, module, patterns, odd):
    rows = module.find(docs(spark, odd)).withColumn("s", spans.joined(F.col("base"))).select("row.doc_id", "s").collect()
    assert {r["doc_id"]: r["s"] for r in rows} == {k: expected(patterns, t) for k, t in enumerate(odd)}
    assert module.find(docs(spark, odd).limit(0)).count() == 0


def test_added_personal_data(spark):
    texts = ["pay to GB82 WEST 1234 5698 7654 32 now", "GB82WEST12345698765433", "ssn 123-45-6789", "part 123-45-6789", "call (555) 123-4567", "x 555-123-4567"]
    rows = pii.find(docs(spark, texts)).select("row.doc_id", F.transform("all", lambda x: x["kind"]).alias("k")).orderBy("doc_id").collect()
    assert [r["k"] for r in rows] == [["iban"], [], ["ssn"], [], ["tel"], []]


def test_random_strings(spark):
    good = ["customerAccountServiceHandler", "MAX_RETRY_COUNT_LIMIT_VALUE", "getUserNameFromDatabase2", "4111111111111111"]
    bad = ["x9Kq2LmZ7vTpR4wYc8Bn", "dGhQ7xWz1LpN3vKs9RtY5bMc"]
    rows = secrets.find(docs(spark, [f"see {t} here" for t in good + bad])).select("row.doc_id", F.size("all").alias("n")).orderBy("doc_id").collect()
    assert [r["n"] for r in rows] == [0] * len(good) + [1] * len(bad)


def test_short_random_strings(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    tokens = ["".join(rng.choice(letters) for _ in range(n)) + "zQ" for n in range(14) for _ in range(20)] + ["getUserName2", "MAX_COUNT", "qQxZjX", "zQ7", "Report"]
    weights = secrets.train(secrets.samples(spark))

    def passes(t):
        codes = [secrets.ALPHABET.index(c) + 1 for c in t]
        total = sum(weights[a * secrets.SYMBOLS + b] for a, b in zip(codes, codes[1:], strict=False))
        return total >= secrets.TOTAL and total >= secrets.EACH * len(t)

    rows = secrets.find(docs(spark, [f"see {t} here" for t in tokens])).select("row.doc_id", F.size("all").alias("n")).collect()
    want = {k: int(passes(t)) for k, t in enumerate(tokens)}
    assert {r["doc_id"]: r["n"] for r in rows} == want
    lengths = {len(tokens[k]) for k, n in want.items() if n}
    assert min(lengths) < 8 and set(range(8, 16)) <= lengths and not any(list(want.values())[-2:])
    assert secrets.shortest(weights) <= min(lengths) and secrets.shortest(weights * 0) == secrets.ALWAYS


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def judged(spark, rows):
    out = url_filter.judge(common.Scratch(spark, "t"), pages(spark, rows)).collect()
    return {r["row"]["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}


def test_rules(spark):
    urls = {1: "https://A.Example.COM/en/x?q#f", 2: "http://www.example.com/en/", 3: "http://x.net/es/", 4: "http://com/", 5: "http://evilcom/", 6: None, 7: "nothing", 8: "http://example.com", 9: "a://b.com://c/d", 10: "http://sub.www.example.com/en/1", 11: "http://..com/x", 12: "http://ÉX.net/fr/É"}
    got = judged(spark, [(k, u, None) for k, u in urls.items()])
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[10][2:] == ("www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][2:] == ("com/", "allow")
    assert got[5][2:] == (None, "allow") and got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("example.com", "", None, "allow") and got[9][:3] == ("b.com:", "//c/d", None)
    assert got[12] == ("Éx.net", "/fr/É", "net/fr/", "block")
    assert judged(spark, []) == {}


def test_distrust_spreads(spark):
    bad = [(k, f"http://bad.net/es/{k}", "") for k in range(3)]
    links = "<a href='http://bad.net/es/1'>x</a>" * 3
    rows = [*bad, (10, "http://friend.org/a", links), (11, "http://fine.org/a", '<a href="//good.com/">x</a>'), (12, "http://good.com/", '<a class=x href=http://linked.org/p>x</a><a href="/own">y</a>'), (13, "http://linked.org/z", None)]
    got = judged(spark, rows)
    assert got[10][3] == "block" and {got[k][3] for k in (11, 12, 13)} == {"allow"}


def ranks(n, edges, start, damping=0.85):
    """Ranks of a small graph by solving the linear system, mass at hosts without links returned to the seeds; a start of 1 a seed."""
    out = np.zeros((n, n))
    for a, b in edges:
        out[b, a] += 1
    dead = out.sum(axis=0) == 0
    out /= np.maximum(out.sum(axis=0), 1)
    out[:, dead] = (start / start.sum())[:, None]
    settled = np.linalg.solve(np.eye(n) - damping * out, (1 - damping) * start)
    return settled / (1 - damping + damping * settled[dead].sum() / start.sum())


def test_distrust_is_settled(spark):
    size, others = 20, 79
    names = ["bad.net", *(f"h{k}.org" for k in range(1, size + 1)), *(f"o{k}.org" for k in range(others))]
    link = [(k, k - 1) for k in range(1, size + 1)] + [(1, 2)]
    to = {a: "".join(f"<a href='//{names[b]}/'>x</a>" for c, b in link if c == a) for a, _ in link}
    rows = [(k, f"http://{name}/{'es/' if k == 0 else 'p'}", to.get(k)) for k, name in enumerate(names)]
    got = {r["host"]: r for r in url_filter.judge(common.Scratch(spark, "t"), pages(spark, rows)).collect()}
    want = ranks(len(names), [(b, a) for a, b in link], np.eye(len(names))[0])
    chain = [got[h]["verdict"] for h in names[1 : size + 1]]
    assert chain == ["block" if w >= url_filter.LEAST else "allow" for w in want[1 : size + 1]] and {*chain} == {"allow", "block"}
    assert max(abs(got[h]["distrust"] - w) for h, w in zip(names, want, strict=True)) <= url_filter.TOLERANCE
    with pytest.raises(RuntimeError):
        links = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n bigint")
        url_filter.spread(common.Scratch(spark, "t"), links, spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, mass double"), most=2)


def test_unrelated_hosts_change_nothing(spark):
    link = lambda h: f"<a href='http://{h}/'>x</a>"
    some = [row for k in range(3) for row in ((10 * k, f"http://half{k}.net/es/", None), (10 * k + 1, f"http://half{k}.net/other", None))]
    some += [(40, "http://one.org/", link("half0.net") + link("good.com")), (41, "http://two.org/", link("half1.net")), (42, "http://good.com/", link("two.org"))]
    alone = judged(spark, some)
    others = [(100 + k, f"http://o{k}.org/", link(f"o{k + 1}.org")) for k in range(10)] + [(200 + k, f"http://b{k}.net/fr/", None) for k in range(5)]
    both = judged(spark, some + others)
    assert {k: both[k] for k in alone} == alone
    assert {alone[k][3] for k in (1, 11, 21)} == {"block"} and {v[3] for v in alone.values()} == {"allow", "block"}


def test_columns_of_any_name(spark):
    names = ["base", "more", "all", "m_email", "row", "host", "__verdict", "spans"]
    for find in (pii.find, secrets.find):
        out = find(docs(spark, ["a@b.co", None]).withColumns({n: F.lit(n) for n in names}))
        assert out.columns == ["row", "base", "all"] and [r["row"].asDict() for r in out.orderBy("row.doc_id").collect()] == [{"doc_id": k} | {n: n for n in names} for k in range(2)]
    out = url_filter.judge(common.Scratch(spark, "t"), pages(spark, [(1, "http://a.com/", "")]).withColumns({n: F.lit(n) for n in names}))
    assert out.first()["row"].asDict() == {"page_id": 1, "url": "http://a.com/"} | {n: n for n in names}


def test_many_matches_in_one_text(spark):
    """Cost grows with the matches: 20,000 base spans beside 20,000 added ones."""
    import time

    n = 20_000
    text = " ".join(f"call 555-{100 + k % 900}-{1000 + k % 9000} u{k}@x.org" for k in range(n))
    began = time.time()
    row = pii.find(docs(spark, [text])).select(F.size("base").alias("b"), F.size("all").alias("a"), F.element_at("all", -2).alias("x")).first()
    assert (row["b"], row["a"]) == (n, 2 * n) and row["x"]["kind"] == "tel" and time.time() - began < 60


def test_overlaps(spark):
    rng = random.Random(9)
    span = lambda: (lambda a: {"start": a, "end": a + rng.randint(1, 9)})(rng.randint(0, 300))
    rows = [(k, sorted((span() for _ in range(rng.choice((0, 1, 5, 300)))), key=lambda x: x["start"]), sorted((span() for _ in range(rng.choice((0, 1, 2, 40)))), key=lambda x: x["start"])) for k in range(30)]
    kind = "array<struct<start:bigint,end:bigint>>"
    got = spans.apart(spark.createDataFrame(rows, f"k int, mine {kind}, others {kind}"), "mine", "others").collect()
    free = lambda x, others: not any(x["start"] < y["end"] and y["start"] < x["end"] for y in others)
    assert {r["k"]: [x.asDict() for x in r["mine"]] for r in got} == {k: [x for x in mine if free(x, others)] for k, mine, others in rows}


def test_mixing_odd_sources(spark):
    rows = [(k, "w " * n, s) for k, (n, s) in enumerate([(5, "a"), (0, "a"), (7, "b"), (7, None), (90, "c"), (3, "é"), (1, "Z")])] + [(6, "w", "Z"), (None, None, "a"), (100, "", "empty")] + [(k, "w w w", "c") for k in range(200, 400)]
    data = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix(common.Scratch(spark, "t"), data).select("row.doc_id", "row.source", "size", "source_size", "target", "copies", "taken").collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    assert sum({s: r[0]["target"] for s, r in by.items()}.values()) == pytest.approx(sum(r["size"] for r in out))
    for r in by.values():
        assert r[0]["target"] <= 3 * r[0]["source_size"]
        assert abs(sum(x["taken"] for x in r) - r[0]["target"]) <= max(x["size"] for x in r)
    full = mixing.mixed_rows(common.Scratch(spark, "t"), data)
    assert full.columns == data.columns and full.count() == sum(r["copies"] for r in out)
    assert mixing.mix(common.Scratch(spark, "t"), data.limit(0)).count() == 0


def test_digest_column(spark):
    from tidewatch.llm.registry import QUERIES

    rows = QUERIES["op2_pii"](spark, SF).collect()
    assert all(hashlib.sha256(r["spans"].encode()).hexdigest() == r["base_sha256"] for r in rows)


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_pii", "op6_mixing", "op8_secrets"])
def test_compiled_plans_agree(spark, name):
    """With whole-stage code generation, which the other tests turn off, the results are the same."""
    from tidewatch.llm.registry import QUERIES

    got = []
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    for on in ("true", "false"):
        spark.conf.set("spark.sql.codegen.wholeStage", on)
        try:
            got.append(sorted(map(repr, QUERIES[name](spark, SF).collect())))
        finally:
            spark.conf.set("spark.sql.codegen.wholeStage", before)
    assert got[0] == got[1] and got[0]
