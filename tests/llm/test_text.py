"""Decontamination, n-gram join, quality, token shards, archives and embeddings: brute force, round trips, odd inputs."""

import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import cells, common, decontaminate, embed_dedup, ngram_join, quality, tokenout, warc
from tidewatch.llm.words import words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def scratch(spark):
    return common.Scratch(spark, "t")


def texts(n=120, seed=1):
    """Random texts of few words, with near copies, copies, empty and null ones."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(50)] + ["É", "ünd", "it's", "A-B", "中文"]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.choice((0, 1, 3, 5, 30, 80)))) for _ in range(n)]
    for k in range(0, n, 4):
        parts = out[k].split()
        for j in range(k + 1, min(k + 3, n)):
            near = list(parts)
            if near and rng.random() < 0.7:
                near[rng.randrange(len(near))] = "changed"
            out[j] = " ".join(near).upper() if rng.random() < 0.3 else " ".join(near)
    return [*out, "", None, " \n", "!!!"]


def test_words():
    column = pa.array(["Ab cD-é1", "", None, "ß\u0301x\x00y", "end", "start", " "])
    for size in (1, 4, 1 << 20):
        got = [[bytes(b.data[b.starts[k] : b.ends[k]]).decode() for k in range(b.bounds[r], b.bounds[r + 1])] for b in words(column, size) for r in range(b.last - b.first)]
        assert got == [split(x) for x in column.to_pylist()]
    grams = [h for b in words(pa.array(["a b c d", "x a b c d"])) for h in [b.grams(4)[0]]][0]
    assert len(grams) == 3 and grams[0] == grams[2] != grams[1]


def test_long_texts(monkeypatch):
    """A text longer than a block gives the same words, n-grams, features and tokens as in one go."""
    rng = random.Random(12)
    text = " ".join("".join(rng.choice("abcDEé9-") for _ in range(rng.randint(1, 9))) for _ in range(4000)) + " " + "x" * 3000 + " end"
    column = pa.array(["short one", text, None, text[:50]])
    whole = list(words(column, 1 << 30))
    few = list(words(column, 512))
    assert np.concatenate([b.hashes for b in few]).tolist() == whole[0].hashes.tolist()
    for n in (1, 5, 10):
        assert np.concatenate([b.grams(n)[0] for b in few]).tolist() == whole[0].grams(n)[0].tolist()
    block = whole[0]
    assert [bytes(b.data[b.starts[k] : b.ends[k]]) for b in few for k in range(len(b.starts))] == [bytes(block.data[a:b]) for a, b in zip(block.starts, block.ends, strict=True)]
    want = quality.features(column)
    from tidewatch.llm import words as words_module

    encoder = tokenout.Encoder.of(str(TOKENIZER))
    ids = [x.tolist() for x in encoder.encode(column)]
    for module in (words_module, quality, tokenout):
        monkeypatch.setattr(module, "BLOCK", 512)
    monkeypatch.setattr(words_module.blocks, "__defaults__", (512,))
    monkeypatch.setattr(words_module.parts, "__defaults__", (512,))
    monkeypatch.setattr(words_module.words_of, "__defaults__", (512,))
    assert np.array_equal(quality.features(column), want)
    assert [x.tolist() for x in encoder.encode(column)] == ids


def test_memory_of_a_long_text():
    """Per byte of a long text a scan holds a bounded multiple, whatever its length."""
    import subprocess
    import sys

    code = """
import resource, numpy as np, pyarrow as pa
from tidewatch.llm import decontaminate, ngram_join, quality
from tidewatch.llm.words import words
rng = np.random.default_rng(0)
text = " ".join(map(str, rng.integers(0, 10**7, 3_000_000)))
column = pa.array([text])
size, peak = len(text) / 1e6, lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3
del text
before = peak()
for block in words(column):
    ngram_join.prints(block)
    h, at = ngram_join.shingles(block)
    ngram_join.sketches(h, at)
quality.features(column)
print((peak() - before) / size)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(said.stdout) < 25


def contaminated(docs, items, n=10):
    wins = defaultdict(set)
    for i, t in items:
        w = split(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            wins[tuple(w[a : a + k])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if (x := tuple(w[a : a + k])) in wins:
                    hit |= set(range(a, a + k))
                    names |= wins[x]
        out.append((d, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def test_decontaminate(spark):
    rng = random.Random(2)
    words_of = lambda n: " ".join(rng.choice("abcdefgh") * 2 for _ in range(n))
    items = [(k, words_of(n)) for k, n in enumerate((30, 12, 10, 9, 4, 7, 0))] + [(1, words_of(15)), (20, None), (21, "Zz Zz")]
    docs = [(k, words_of(40)) for k in range(20)] + [(50, f"{words_of(5)}, {items[0][1].upper()} {words_of(3)}"), (51, items[1][1]), (51, "zz zz zz"), (52, None), (None, items[2][1][:-1]), (53, ""), (54, items[0][1] + ". " + items[0][1])]
    data = spark.createDataFrame(docs, "key bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.report(scratch(spark), data, bench).collect()
    assert sorted(((r["key"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == contaminated(docs, items)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("uid", F.lit("x")).withColumn("n", F.lit(1))
    kept = decontaminate.clean(scratch(spark), table, bench)
    assert kept.columns == table.columns and kept.count() == sum(1 for r in got if not r["contaminated"])
    assert decontaminate.report(scratch(spark), data, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.report(scratch(spark), data.limit(0), bench).count() == 0


def linked(rows, threshold=0.8, k=5):
    sets = []
    for _, t in rows:
        w = split(t)
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    n, root = Counter(), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                n[a] += 1
                n[b] += 1
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    least = defaultdict(list)
    for r, (d, _) in zip(root, rows, strict=True):
        least[r].append(d)
    return sorted((d, n[k], min(least[root[k]])) for k, (d, _) in enumerate(rows))


@pytest.mark.parametrize("limit", [ngram_join.LIMIT, 3])
def test_ngram_join(spark, monkeypatch, limit):
    monkeypatch.setattr(ngram_join.buckets, "__defaults__", (limit, ngram_join.DEPTH))
    rows = list(enumerate(texts(90))) + [(3, "one two three four five six seven"), (3, "seven six five four three two one")]
    data = spark.createDataFrame(rows, "key bigint, text string")
    got = ngram_join.join(scratch(spark), data).collect()
    assert sorted((r["key"], r["n_links"], r["class_key"]) for r in got) == linked(rows)


def near_copies(rng, n, size, changed):
    """Texts of ``size`` words, each the same one with a run of up to ``changed`` words replaced."""
    base = [f"b{k}" for k in range(size)]
    out = []
    for k in range(n):
        at, own = rng.randrange(size - changed), list(base)
        for j in range(rng.randint(0, changed)):
            own[at + j] = f"n{k}x{j}"
        out.append(" ".join(own))
    return out


def test_ngram_join_of_a_large_group(spark):
    """One group of 1,500 near copies among others: every link is found, and rows grow with the group, not its square."""
    rng = random.Random(13)
    rows = list(enumerate(near_copies(rng, 1500, 150, 3) + [" ".join(rng.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(100)]))
    s = scratch(spark)
    got = ngram_join.join(s, spark.createDataFrame(rows, "key bigint, text string").repartition(4)).collect()
    sets = []
    for _, t in rows:
        w = split(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    vocabulary = {g: k for k, g in enumerate({g for x in sets for g in x})}
    m = np.zeros((len(sets), len(vocabulary)), np.float32)
    for k, x in enumerate(sets):
        m[k, [vocabulary[g] for g in x]] = 1
    both, size = m @ m.T, m.sum(axis=1)
    alike = (both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-4) & ~np.eye(len(m), dtype=bool)
    label = cells.forest(alike)
    assert {r["key"]: (r["n_links"], r["class_key"]) for r in got} == {k: (int(alike[k].sum()), int(label[k])) for k in range(len(rows))}
    distinct = len({t for _, t in rows})
    left = spark.read.parquet(s.path("left")).count()
    assert distinct > 1000 and left < 0.5 * distinct


def test_recall_at_the_threshold(spark):
    """Pairs whose Jaccard similarity is 0.8 exactly are found, however many buckets they are lost in."""
    rows = []
    for k in range(400):
        w = [f"a{k}x{j}" for j in range(40)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + [f"z{k}x{j}" for j in range(9)]))]  # 36 of 45 shingles
    got = {r["key"]: r["n_links"] for r in ngram_join.join(scratch(spark), spark.createDataFrame(rows, "key bigint, text string")).collect()}
    want = {d: n for d, n, _ in linked(rows[:8])}
    assert sum(want.values()) == 8  # each pair links
    assert np.mean([got[k] == 1 for k in range(len(rows))]) >= 0.99


def test_rows_of_one_key(spark):
    """Rows that share a null or other key are documents of their own; the key costs nothing."""
    rng = random.Random(15)
    texts_ = [f"w{k} " + " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(30)) for k in range(300)]
    rows = [(None, t) for t in texts_ + texts_] + [(7, t + " more") for t in texts_] + [(7, texts_[0] + " more")] * 3
    s = scratch(spark)
    got = ngram_join.join(s, spark.createDataFrame(rows, "key bigint, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    want = Counter((d, n, least) for d, n, least in linked_by_row(rows))
    assert Counter((r["key"], r["n_links"], r["class_key"]) for r in got) == want


def linked_by_row(rows):
    """``linked`` with null keys, which sort last."""
    out = linked([((d is None, d or 0), t) for d, t in rows])
    back = lambda d: None if d[0] else d[1]
    return [(back(d), n, back(least)) for d, n, least in out]


def test_one_of_each(spark):
    rows = list(enumerate(texts(40))) + [(7, "same words here again and again")] * 3
    data = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit(1)).withColumn("uid", F.lit("x"))
    out = ngram_join.one_of_each(scratch(spark), data)
    assert out.columns == data.columns
    classes = {c for _, _, c in linked(rows)}
    assert {r["doc_id"] for r in out.collect()} == classes
    assert ngram_join.one_of_each(scratch(spark), data.limit(0)).count() == 0


def test_blocks_meet_once(spark):
    members = spark.range(40).select(F.lit(1).alias("b"), "id")
    placed = cells.dealt(members, F.lit(4)).collect()
    met = Counter()
    for cell in {(r["ci"], r["cj"]) for r in placed}:
        own = [(r["id"], r["side"]) for r in placed if (r["ci"], r["cj"]) == cell]
        for x, s in own:
            for y, t in own:
                if x < y and (cell[0] == cell[1] or s != t):
                    met[x, y] += 1
    assert len(met) == 40 * 39 // 2 and set(met.values()) == {1}


def test_few_rows_are_compared_together(monkeypatch):
    """Cells of few rows, cut by batches anywhere, give the links and weights that cells give one by one."""
    rng = np.random.default_rng(17)
    n = 900
    unit = rng.normal(size=(n, 3))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    group = np.sort(rng.choice([0, 1, 2, 3, 5, 8, *range(10, 150)], n))
    columns = [pa.array(group), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n) * 7 % 1009), pa.array(np.zeros(n, np.int32)), pa.array([u.tobytes() for u in unit]), pa.array(rng.integers(1, 5, n))]
    table = pa.table(columns, ["b", "ci", "cj", "id", "side", "unit", "copies"])
    ids, w = table.column("id").to_numpy(), table.column("copies").to_numpy()
    alike = embed_dedup.alike(0.8)
    linked = alike(table) & (group[:, None] == group[None, :]) & ~np.eye(n, dtype=bool)
    own = {int(i): int(x) for i, x in zip(ids, linked @ w, strict=True) if x}

    class Rows:
        columns = table.column_names

        def __getattr__(self, name):
            return lambda *args: self

        def mapInArrow(self, run, kinds):
            return pa.Table.from_batches(list(run(iter(table.to_batches(max_chunksize=37)))))

    label = cells.forest(linked)
    for few in (0, 16):
        monkeypatch.setattr(cells, "FEW", few)
        got = cells.compared(Rows(), alike, "copies").to_pydict()
        sums, edges = Counter(), []
        for a, b, k in zip(got["a"], got["b"], got["n"], strict=True):
            if b is None:
                sums[a] += k
            else:
                edges.append((a, b))
        assert sums == own
        at = {int(i): k for k, i in enumerate(ids)}
        m = np.zeros((n, n), bool)
        for a, b in edges:
            m[at[a], at[b]] = m[at[b], at[a]] = True
        assert np.array_equal(cells.forest(m), label)


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 101), (101, 100), (5, 5), (200, 3)]
    got = common.components(scratch(spark), spark.createDataFrame(edges, "a bigint, b bigint"), "c").collect()
    assert {r["id"]: r["root"] for r in got} == {**dict.fromkeys(range(21), 0), 200: 0, 100: 100, 101: 100} and len(got) == 24
    assert common.components(scratch(spark), spark.createDataFrame([], "a bigint, b bigint"), "c").count() == 0


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    from tidewatch.llm.registry import QUERIES

    got = QUERIES["op9_quality"](spark, f"{SF}/../sf0.01").join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) / len(got) >= 0.93
    extra = docs.withColumn("__score_", F.lit(1)).withColumn("key", F.lit("x")).limit(50)
    odd = extra.limit(2).withColumn("text", F.lit(None).cast("string")).unionByName(extra.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    out = quality.keep(scratch(spark), extra.unionByName(odd), labels.unionByName(labels.withColumn("quality", F.lit(None).cast("int"))))
    assert out.columns == extra.columns and 30 <= out.count() <= 53
    assert quality.keep(scratch(spark), extra, labels.limit(0)).count() == 50
    assert quality.keep(scratch(spark), extra.limit(0), labels).count() == 0


def test_quality_cut_takes_all_rows(spark):
    rng = np.random.default_rng(4)
    n, width = 600, len(quality.NAMES)
    label = (rng.random(n) < 0.7).astype(int)
    x = (rng.normal(size=(n, width)) + label[:, None] * rng.random(width)).astype(np.float32)
    found = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "key bigint, x array<float>")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(label)], "key bigint, label int")
    model = quality.learn(scratch(spark), found, labels, max_fit=20)
    kept = [r["key"] for r in found.filter(~quality.held_out(F.col("key"))).select("key").collect()]
    s, bad = np.sort(((x[kept].astype(np.float64) - model.mean) / model.scale) @ model.weights), int((label[kept] == 0).sum())
    assert 20 < bad < len(kept) - 20 and model.cut == pytest.approx((s[bad - 1] + s[bad]) / 2, abs=1e-9)
    assert (s < model.cut).sum() == bad


def test_ranked(spark, monkeypatch):
    monkeypatch.setattr(quality, "BINS", 4)
    monkeypatch.setattr(quality, "FEW", 3)
    rng = np.random.default_rng(5)
    for values in (np.round(rng.normal(size=80), 1).tolist(), [1.0] * 30, [0.0, 5e-324] * 9, [-1e300, *rng.normal(size=20).tolist(), 1e300]):
        df = spark.createDataFrame([(v,) for v in values], "s double").coalesce(1).persist()
        for rank in (0, len(values) // 3, len(values) - 1):
            assert quality.ranked(df, rank) == sorted(values)[rank]


TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    parts = [*"abTSx'sLD09.,!-_<|> \n\t", "é", "É", "\u0301", "\u030c", "J", "\u00a0", "ſ", "İ", "Σ", "中", "½", "…", "\U0001f600", "\u0338", "<|endoftext|>", "'RE", "\x1c", "\x85"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", None]
    encoder = tokenout.Encoder.of(str(TOKENIZER))
    got = [x.tolist() for lo in range(0, len(some), 40) for x in encoder.encode(pa.array(some[lo : lo + 40]))]
    want = [x.ids for x in Tokenizer.from_file(str(TOKENIZER)).encode_batch([x or "" for x in some], add_special_tokens=False)]
    assert got == want


def test_shards(spark):
    from tokenizers import Tokenizer

    rows = [(k * 7 % 60, t) for k, t in enumerate(texts(50))] + [(None, "null id"), (5, "twice"), (5, "twice")]
    data = spark.createDataFrame(rows, "doc_id bigint, text string")
    s = scratch(spark)
    manifest = tokenout.write(s, data, f"file://{s.path('files')}", str(TOKENIZER))
    got = sorted(tokenout.read(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    at = 0
    encode = Tokenizer.from_file(str(TOKENIZER))
    crc = Counter()
    for d, t in rows:
        crc[d, zlib.crc32(np.array(encode.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())] += 1
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == crc
    first = manifest.orderBy("shard").first()
    assert len(tokenout.record_at(first["path"], first["docs"] - 1)) >= 12
    assert tokenout.read(tokenout.write(scratch(spark), data.limit(0), "file:///nowhere", str(TOKENIZER))).count() == 0


def test_urls():
    assert [common.url(x) for x in ("/a/b", "file:/a/b", "file:///a/b", "hdfs://n/a")] == ["file:///a/b"] * 3 + ["hdfs://n/a"]


def test_damaged_shard():
    framed = tokenout.frame(b"abc") + tokenout.frame(b"")
    stream = io.BytesIO(framed)
    assert [tokenout.unframe(stream) for _ in range(3)] == [b"abc", b"", None]
    for k in range(len(framed) - 16):
        broken = bytearray(framed)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            tokenout.unframe(io.BytesIO(bytes(broken)))


def archive(spark, rows, revisit_from=0):
    s = scratch(spark)
    data = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    return warc.write(s, data, f"file://{s.path('a')}", revisit_from)


def test_archives(spark):
    rows = [(1, "http://a/", "same"), (9, "http://b/\r\nX: y", "same"), (4, None, "same"), (2, "u", None), (3, "u", ""), (None, "n", "é" * 5000), (7, "r", "x\r\n\r\ny"), (7, "r", "x\r\n\r\ny")]
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], bytes(r["payload"]).decode() if r["payload"] is not None else None) for r in warc.read(archive(spark, rows)).collect()}
    assert got == {(1, "revisit", 9, 4, None), (9, "response", None, 4, "same"), (4, "revisit", 9, 4, None), (2, "revisit", 3, 0, None), (3, "response", None, 0, ""), (None, "response", None, 10000, "é" * 5000), (7, "response", None, 6, "x\r\n\r\ny")}
    manifest = archive(spark, rows)
    for path in [r["path"].removeprefix("file://") for r in manifest.collect()]:  # on disk: the dictionary's frame, then one frame a record
        with open(path, "rb") as f:
            assert int.from_bytes(f.read(4), "little") == warc.DICTIONARY_FRAME
    few = warc.read(archive(spark, rows, revisit_from=5), payloads=False).collect()
    assert len(few) == len(rows) and {r["record_type"] for r in few} == {"response"}
    assert warc.read(archive(spark, rows).limit(0)).count() == 0


def test_damaged_archive():
    raw = warc.record(1, "http://a", b"payload", "A" * 32, None, False)
    with pytest.raises(warc.Damaged):
        warc.page(*warc.parsed(raw), True)  # the digest is wrong
    for broken in (raw[:-1], raw.replace(b"WARC/1.1", b"WARC/9"), raw.replace(b"WARC-Date", b"X-Date"), raw.replace(b"Content-Length: 7", b"Content-Length: 77", 1)):
        with pytest.raises(warc.Damaged):
            warc.page(*warc.parsed(broken), True)
    learned = b"dictionary text " * 20
    body = warc.leading_frame(learned) + warc.compressor(learned).compress(warc.info()) + warc.compressor(learned).compress(raw)
    assert list(warc.records(io.BytesIO(body))) == [warc.info(), raw]
    for broken in (body[:-3], body[:-20] + b"\x00" * 20, b"junk" + body):
        with pytest.raises(warc.Damaged):
            list(warc.records(io.BytesIO(broken)))


def test_foreign_archive(spark, tmp_path):
    """No content size in the frames, no dictionary, no HTTP length, other digests and types, no known count."""
    import hashlib

    import zstandard

    def made(kind, block, *more):
        lines = [("WARC-Type", kind), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "2020-01-01T00:00:00Z"), *more, ("Content-Length", str(len(block)))]
        return warc.head(lines) + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    body = b"payload " * 100
    sha = hashlib.sha256(body).hexdigest()
    found = [made("response", http + body, ("WARC-Payload-Digest", f"sha256:{sha}")), made("response", http + b"b", ("WARC-Payload-Digest", "other:zz")), made("response", http), made("response", b"dns answer", ("Content-Type", "text/dns")), made("request", b"GET / HTTP/1.1\r\n\r\n"), made("revisit", http, ("WARC-Payload-Digest", f"sha256:{sha}")), made("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n1\r\nb\r\n0\r\n\r\n")]
    press = zstandard.ZstdCompressor(write_content_size=False)
    path = tmp_path / "foreign.warc.zst"
    path.write_bytes(b"".join(press.compress(r) for r in found))
    manifest = spark.createDataFrame([(f"file://{path}", None)], "path string, records bigint")
    got = sorted(((r["record_type"], r["payload_bytes"], bytes(r["payload"] or b"")) for r in warc.read(manifest).collect()))
    assert got == sorted([("response", 800, body), ("response", 1, b"b"), ("response", 0, b""), ("response", 10, b"dns answer"), ("revisit", 0, b""), ("response", 11, b"1\r\nb\r\n0\r\n\r\n")])
    with pytest.raises(warc.Damaged):
        warc.page(*warc.parsed(made("response", http + b"other", ("WARC-Payload-Digest", f"sha256:{sha}"))), True)
    with pytest.raises(warc.Damaged):
        warc.decoded(zstandard.ZstdDecompressor(), press.compress(b"x" * 5000), 100)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 24))
    near = base[:30] + rng.normal(size=(30, 24)) * 0.15
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate((base, near, base[:5] * 3, np.repeat(base[7:8], 6, axis=0))))]
    good = np.array([v for _, v in rows])
    rows += [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] + [1.0] * 23), (904, []), (905, [1.0, 0.0]), (906, [2.0, 0.0]), (907, [float("inf")] + [0.0] * 23), (908, [1e-300] * 24)]
    got = {r["key"]: (r["n_links"], r["component"]) for r in embed_dedup.dedup(scratch(spark), spark.createDataFrame(rows, "key bigint, embedding array<double>")).collect()}
    unit = good / np.linalg.norm(good, axis=1)[:, None]
    alike = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    label = cells.forest(alike)
    assert {k: got[k] for k in range(len(good))} == {k: (int(alike[k].sum()), int(label[k])) for k in range(len(good))}
    assert {k: got[k] for k in (900, 901, 902, 903, 904, 907)} == {k: (0, k) for k in (900, 901, 902, 903, 904, 907)}
    assert got[905] == got[906] == (1, 905) and got[908] == (0, 908)


@pytest.mark.parametrize("d", [64, 384])
def test_embedding_recall(spark, d):
    """Pairs at the threshold are found, at the number of rotations that many more vectors need."""
    rng = np.random.default_rng(6)
    n = 800
    a, b = rng.normal(size=(2, n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    pairs = 0.9501 * a + np.sqrt(1 - 0.9501**2) * b
    for count, deeper in ((2 * n, 0), (10**9, 0), (10**6, embed_dedup.DEEPER)):
        parts = embed_dedup.parts_for(count, embed_dedup.padded(d))
        (x, xd), (y, yd) = (embed_dedup.probe(v, parts=parts) for v in (a, pairs))
        width = 1 + embed_dedup.PROBES
        xd, yd = (np.repeat(v.reshape(n, -1, embed_dedup.DEEPER, 2)[:, :, :deeper], width, axis=1) for v in (xd, yd))

        def both(r):
            """Whether a pair shares a bucket, and in it one of the vertices of each further rotation."""
            where = {int(k): xd[r, j] for j, k in enumerate(x[r])}
            return any(all({*where[int(k)][m]} & {*yd[r, j, m]} for m in range(deeper)) for j, k in enumerate(y[r]) if int(k) in where)

        assert np.mean([both(r) for r in range(n)]) >= 0.99, (count, deeper, parts)


def test_embeddings_in_divided_buckets(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup.buckets, "__defaults__", (8,))
    rng = np.random.default_rng(7)
    x = rng.normal(size=16) + rng.normal(size=(120, 16)) * 0.12
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    alike = (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = {r["key"]: (r["n_links"], r["component"]) for r in embed_dedup.dedup(scratch(spark), spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "key bigint, embedding array<double>")).collect()}
    label = cells.forest(alike)
    assert alike.sum() > 2000 and got == {k: (int(alike[k].sum()), int(label[k])) for k in range(len(x))}
    repeated = [(1, x[0].tolist()), (1, x[0].tolist()), (1, (-x[0]).tolist()), (None, x[0].tolist())]
    got = embed_dedup.dedup(scratch(spark), spark.createDataFrame(repeated, "key bigint, embedding array<double>").withColumn("id", F.lit(1)))
    assert sorted((r["n_links"], r["component"] or 0) for r in got.collect()) == [(0, 1), (2, 1), (2, 1), (2, 1)]
    assert embed_dedup.dedup(scratch(spark), spark.createDataFrame([], "key bigint, embedding array<float>")).count() == 0


@pytest.mark.parametrize("name", ["op1_url_filter", "op3_decontaminate", "op4_embed_dedup", "op5_warc", "op6_mixing", "op7_ngram_join"])
def test_oracles(spark, name):
    import duckdb

    from tidewatch.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_weights_by_plain_ascent():
    """Newton's weights are where slow gradient ascent on the pair likelihood ends."""
    rng = np.random.default_rng(16)
    good, bad = rng.normal(size=(300, 5)) + [1, 0.5, 0, 0, -1], rng.normal(size=(200, 5))
    model = quality.fit(good, bad, pairs=2000, ridge=5.0, seed=3)
    both = np.concatenate((good, bad))
    z = (both - both.mean(axis=0)) / both.std(axis=0)
    draw = np.random.default_rng(3)
    diff = z[draw.integers(0, 300, 2000)] - z[300 + draw.integers(0, 200, 2000)]
    w = np.zeros(5)
    for _ in range(4000):
        w += 1e-3 * (diff.T @ (1 / (1 + np.exp(diff @ w))) - 5.0 * w)
    assert model.weights == pytest.approx(w, abs=1e-4)
    wins = (model.raw(good)[:, None] > model.raw(bad)[None, :]).mean()
    assert wins > 0.85


def slow_features(text):
    """What ``quality.features`` gives for one text, word by word."""
    raw, w = (text or "").encode(), split(text)
    if not raw:
        return np.zeros(len(quality.NAMES))
    n, size, lines = max(len(w), 1), len(raw), raw.count(b"\n")
    share = lambda some: np.sqrt(sum(raw.count(bytes([c])) for c in some) / size)
    lengths = [len(x.encode()) for x in w]
    out = [np.log1p(len(w)), sum(lengths) / n, len(set(w)) / np.sqrt(n), np.sqrt(sum(a == b for a, b in zip(w, w[1:], strict=False)) / n), sum(x <= 2 for x in lengths) / n, sum(x >= 12 for x in lengths) / n, np.log1p(len(w) / (lines + 1)), np.log1p(lines)]
    out += [share(g) for g in (range(65, 91), range(97, 123), range(48, 58), [10], [32], range(128, 256))]
    return np.array(out + [share([c]) for c in quality.PUNCTUATION])


def test_features_word_by_word():
    some = texts(60) + ["Line one.\nLine two!\n\n", "é" * 20, "same same same", "A-B, c: (d)"]
    assert quality.features(pa.array(some)) == pytest.approx(np.array([slow_features(t) for t in some]), abs=1e-9)


def mixed_by_hand(rows, weights=(1, 2, 3), cap=3):
    """How often each of (doc_id, text, source) is taken: budgets by shares that are given again until none is above the cap, then whole rounds and a hash threshold."""
    import hashlib

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(size))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > cap * total[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = float(cap * total[s])
            left -= target[s]
            open_.remove(s)
    hashes = [int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16) for d, _, _ in rows]
    taken = [0] * len(rows)
    for s in names:
        own = [k for k, r in enumerate(rows) if r[2] == s]
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, upto, threshold = target[s] - whole * total[s], 0, -1
        for h in sorted({hashes[k] for k in own}):
            more = sum(size[k] for k in own if hashes[k] == h)
            if upto + more > rest:
                threshold = h if upto + more - rest < rest - upto else h - 1
                break
            upto += more
        for k in own:
            taken[k] = whole + (hashes[k] <= threshold)
    return taken


def test_pipeline(spark):
    """Every stage against a slow form of it, on whole sample documents and odd rows."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    data = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None), (None, "null id " + "and some more words here " * 3, "a"), (5, "", "a"), (5, "", "a"), (10**9, "", None)]
    first = data.first()
    odd += [(first["doc_id"], first["text"], first["source"])] * 2
    more = spark.createDataFrame(odd, "doc_id bigint, text string, source string").withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("bigint")})
    now = data.unionByName(more).withColumns({c: F.lit(c) for c in ("row", "uid", "key", "h", "fp", "s", "__text", "__score", "sha", "size")})
    columns, labels = now.columns, spark.read.parquet(f"{SF}/labels.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out, kept = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"], r["source"]) for r in now.select("doc_id", "text", "source").collect()]
        after = common.Scratch(spark, "tp").write(stage(spark, now, SF), name)
        out[name] = before
        if name != "tokens":
            assert after.columns == columns
            kept[name] = Counter((r["doc_id"], r["text"], r["source"]) for r in after.select("doc_id", "text", "source").collect())
            now = after
    rows = out["quality"]
    found = spark.createDataFrame([(d, slow_features(t).astype(np.float32).tolist()) for d, t, _ in rows], "key bigint, x array<float>")
    model = quality.learn(scratch(spark), found, quality.labelled(labels))
    scores = model.scores(np.array([slow_features(t) for _, t, _ in rows]))
    sure = [(r, s >= quality.CUT) for r, s in zip(rows, scores, strict=True) if abs(s - quality.CUT) > 1e-6]
    assert len(sure) > len(rows) - 3 and 10 < sum(k for _, k in sure) < len(rows)
    # rows of one text and id are judged alike
    assert all((kept["quality"][r] > 0) == k for r, k in sure)
    rows = out["ngram_join"]
    least = {c for _, _, c in linked_by_row([(d, t) for d, t, _ in rows])}
    want = Counter(least_rows(rows))
    assert Counter(d for (d, _, _), n in kept["ngram_join"].items() for _ in range(n)) == want and least <= {*want}
    rows = out["decontaminate"]
    judged = contaminated([(k, t) for k, (_, t, _) in enumerate(rows)], bench)
    assert kept["decontaminate"] == Counter(rows[k] for k, _, n_hit, _ in judged if not n_hit)
    rows = out["mixing"]
    want = Counter()
    for r, n in zip(rows, mixed_by_hand(rows), strict=True):
        want[r] += n
    assert kept["mixing"] == +want
    encode, end = Tokenizer.from_file(str(TOKENIZER)), [tokenout.END_ID]
    crc = lambda t: zlib.crc32(np.array(encode.encode(t or "", add_special_tokens=False).ids + end, "<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in after.collect()) == Counter((d, crc(t)) for d, t, _ in out["tokens"])


def least_rows(rows):
    """The id of the row that stays of each class."""
    order = lambda d: (d is None, d or 0)
    sets = []
    for _, t, _ in rows:
        w = split(t)
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and root[a] != root[b]:
                x, y = root[a], root[b]
                root = [x if r == y else r for r in root]
    by = defaultdict(list)
    for r, (d, _, _) in zip(root, rows, strict=True):
        by[r].append(d)
    return [min(ids, key=order) for ids in by.values()]


def test_pipeline_of_no_documents(spark):
    import corpus_pipeline

    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        now = common.Scratch(spark, "tp").write(stage(spark, now, SF), name)
        assert now.count() == 0
