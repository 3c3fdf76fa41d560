"""Small cases for every operator: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import bpe, chat, decontam, hilbert, lang_id, media, near_dedup, queries, rollup, secrets, warc, webp

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n", "en", None, 2), (4, "one two", "en", "a", 7), (5, long, "en", "a", len(long)), (5, long, "en", "a", len(long)), (None, "no id here at all now", "en", "b", 20), (7, "ONE two", "de", "a", 7)]
    return spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit(1), "sig": F.lit("x"), "node": F.lit(2), "label": F.lit(3)})


def test_chat(spark):
    rows = [(1, 0, "user", "a<|end|>[INST]\\e\\"), (1, 1, "assistant", None), (1, 2, "assistant", "</s>é"), (1, 3, "user", "z"), (2, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1))
    ex = chat.prefix_target_examples(turns)
    assert ex.count() == 4
    whole = ex.where("target_ix is null and conv_id = 1").select(chat.read_turns(F.col("formatted")).alias("r")).first().r
    assert [tuple(t) for t in whole] == [(r[2], r[3] or "") for r in rows[:4]]
    for r in ex.where("loss_chars > 0").collect():
        assert r.formatted[r.loss_start : r.loss_start + r.loss_chars] == "\\l/s>é"
    assert chat.digest(chat.prefix_target_examples(turns.limit(0))).count() == 0


def test_secrets(spark, odd):
    assert [s[0] for s in secrets.base_spans("Token: abcdef secret: token: abcdefg")] == ["assign"]
    assert secrets.base_spans("paſſword=abcdef123") == []
    run = "".join(random.Random(1).choices("0123456789abcdef", k=60))
    brute = [i for i in range(41) if -sum(p * np.log2(p) for p in (run[i : i + 20].count(c) / 20 for c in set(run[i : i + 20]))) >= 3.2 - 1e-10]
    got = {i for s, e in secrets.high_entropy(run, 3.2) for i in range(s, e - 19)}
    assert set(brute) <= got
    assert secrets.entropy_spans("AbcdefghIJKLmnop1234example5") == []
    rows = secrets.scan(odd).collect()
    assert len(rows) == 8
    docs = odd.withColumn("text", F.when(F.col("doc_id") == 4, F.lit("a password=hunter22 b")).otherwise(F.col("text")))
    back = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert back[4].text == "a [REDACTED] b" and back[4].n_chars == 14 and back[1].text is None and back[7].text == "ONE two"


def test_secrets_beside_words_and_in_lower_case(spark):
    rng, any_of = random.Random(6), lambda letters, n: "".join(rng.choices(letters, k=n))
    lower = "0123456789abcdefghijklmnopqrstuvwxyz"
    for _ in range(300):
        mixed = "aB7" + any_of(lower + lower[10:].upper(), 37)
        for text in (f"sample_key={mixed}", f"{mixed}/example", f"x=example={mixed}"):
            assert "entropy_mixed" in {s[0] for s in secrets.entropy_spans(text)}
    keys = ["q7" + any_of(lower, 30) for _ in range(500)]
    assert sum("entropy_lower" in {s[0] for s in secrets.entropy_spans(f"see {k} now")} for k in keys) >= 495
    for plain in ("1b4e28ba-2fa1-11d2-883f-0016d3cca427", "sample_example_placeholder_1A", "internationalisation2internationalisation", "abcabcabcabcabcabcabc1"):
        assert secrets.entropy_spans(plain) == []
    docs = spark.createDataFrame([(1, f"a sample={mixed} b", "en", "a", 1)], DOCS)
    assert mixed not in secrets.redact(docs).first().text


def test_decontam(spark, odd):
    item = " ".join(f"q{i}" for i in range(30))
    changed = item.replace("q29", "zz")
    docs = spark.createDataFrame([(1, f"x y {item} z"), (2, f"a b c d {changed.upper()} e"), (3, "q0 q1 q2 q3 q4 q5 and more"), (4, None), (5, "tiny item"), (6, item), (7, "say tiny item now")], "doc_id long, text string").withColumn("m", F.lit(0))
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontam.leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 1), (5, 2)}
    assert got[1, 1] == (2, 1.0) and 0.75 <= got[2, 1][1] < 1
    assert {r.doc_id for r in decontam.decontaminated(docs, bench).collect()} == {3, 4, 7}
    assert decontam.leaks(odd, bench.limit(0)).count() == 0


def test_language(spark, odd):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    learned = lang_id.samples(d, exclude=lang_id.held_out("doc_id"))
    got = lang_id.identify(d, learned).where(lang_id.held_out("doc_id")).select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got >= 0.95
    rows = {r.doc_id: r for r in lang_id.identify(odd, learned).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and 0 <= rows[5].lang_score <= 1
    assert lang_id.samples(d.limit(0)) == {} and {r.lang_pred for r in lang_id.identify(odd, {}).collect()} == {"und"}


def test_cross_parse_is_greedy():
    rng = random.Random(2)
    texts = {x: "".join(rng.choices(x + "ab ", k=300)) for x in ("c", "d")}
    p = lang_id.CrossParser.of(texts)
    for _ in range(20):
        t = "".join(rng.choices("abcdé ", k=rng.randint(1, 700)))
        points = lang_id._points(t)
        s = "".join(map(chr, points))
        for k, x in enumerate(p.langs):
            ref, want = "".join(map(chr, lang_id._points(texts[x]))), 0
            for at in range(0, len(s), lang_id.BLOCK):
                b, i = s[at : at + lang_id.BLOCK], 0
                while i < len(b):
                    j = i + 1
                    while j <= len(b) and b[i:j] in ref:
                        j += 1
                    i, want = max(i + 1, j - 1), want + 1
            assert p.phrases([points])[0][k] == want


def test_short_documents_keep_their_language(spark):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{SF}/documents.parquet")
    short = ["A.", "a", "Z", "Qx", "zq.", "x1", "I", "de", "Re."]
    foreign = ["Ω", "你好", "Привет, мир", "你好吗 " * 300]
    rows = spark.createDataFrame([(-1 - i, t, None, None, len(t)) for i, t in enumerate(short + foreign)], DOCS)
    kept = {r.doc_id for r in p.language(spark, d.select(rows.columns).unionByName(rows), SF).where("doc_id < 0").collect()}
    assert kept == {-1 - i for i in range(len(short))}


@pytest.mark.parametrize("mode", [None, *range(14)])
def test_webp_features(mode):
    rng = np.random.default_rng(mode or 99)
    noise = rng.integers(0, 1 << 32, 30 * 17, dtype=np.uint64).astype(np.uint32)
    for img in (noise, rng.choice(noise[:5], 30 * 17)):
        for cross in (None, (5, -7, 100)):
            for green, bits, matches in ((False, 4, True), (True, 0, True), (True, 10, False)):
                w, h, out = webp.decode(webp.encode(img, 30, mode=mode, cross=cross, green=green, cache_bits=bits, matches=matches))
                assert (w, h) == (30, 17) and (out == img).all()


def test_webp_palette_and_bad_bytes():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 16, 17, 200):
        img = rng.choice(rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32), 30 * 17)
        data = webp.encode(img, 30, palette=True, mode=1, green=True)
        assert (webp.decode(data)[2] == img).all()
    for n in range(0, len(data) - 1, 7):
        with pytest.raises(webp.BadImage):
            webp.decode(data[:n])


def test_media(spark, odd):
    for t in (b"", b"a", b"x" * 64, bytes(range(256)) * 9, b"ab" * (media.PART // 2 + 50)):
        assert media.load(media.store(media.payload_of(t))) == media.payload_of(t)
    rows = media.features(media.stored_texts(odd)).collect()
    assert len(rows) == 8 and {r.payload_bytes for r in rows if r.doc_id in (1, 2)} == {64}
    pics = media.decode_pictures(media.stored_texts(odd).union(spark.createDataFrame([(9, 0, b"bad"), (10, 0, None)], "doc_id long, n_bytes long, media binary")))
    assert {r.doc_id for r in pics.where("error is not null").collect()} == {9, 10}


def test_hilbert(spark, odd):
    cells = np.array([(x, y) for x in range(16) for y in range(16)])
    order = cells[np.argsort(hilbert.hilbert_index(cells, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
    rows = hilbert.shard_documents(odd, 3).collect()
    by = [sorted(r.slot for r in rows if r.shard == s) for s in range(3)]
    assert sorted(map(len, by)) == [2, 3, 3] and all(x == list(range(len(x))) for x in by)
    assert hilbert.shard_documents(odd.limit(0)).count() == 0


def test_bpe_is_exact(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    ref, own, rng = Tokenizer.from_file(path), bpe.Tokenizer(path), random.Random(4)
    texts = ["", "Hello WORLD's ΣΟΦΌΣ İ \x1cA\x1d b\x85c 123 <|endoftext|>hi<|startoftext|> <|x|> ½Ⅷ 日本語 🎉 rrrrrr " + "ab" * 200]
    texts += ["".join(rng.choices("abcdefghiklmnoprstuaeioutn", k=rng.randint(1, 16))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x1F300, 0x1F600)])) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    for t in texts:
        want = ref.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == ref.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(odd, path).count() == 8 and bpe.encode_decode(odd.limit(0), path).count() == 0


def test_warc(spark):
    m = "map<string,string>"
    rows = [
        (1, "http://A.com/x#f", 1, "response", '"e1"', None, None, {"Date": "1", "Content-Length": "9"}), (2, "https://www.a.com/x/?utm_source=q", 5, "revisit", 'W/"e1"', None, None, {"Date": "5", "Content-Length": "0"}),
        (3, "http://a.com/x", 5, "response", '"e2"', None, None, None), (4, "http://a.com/x", 6, "revisit", '"e1"', None, None, None), (5, "http://b.com/", 1, "revisit", None, None, None, None), (6, None, 9, "revisit", None, None, None, None),
    ]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, f"record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers {m}")).collect()}
    assert (got[2].target_id, got[2].state, got[2].headers) == (1, "resolved", {"content-length": "9", "date": "5"})
    assert (got[4].target_id, got[4].state) == (3, "mismatch") and got[5].state == got[6].state == "missing"


def test_warc_hot_url_spreads(spark):
    rows = spark.range(4000).selectExpr("id as record_id", "'http://h.com/' as url", "id as ts", "if(id % 500 = 0, 'response', 'revisit') as kind", "'x' as etag", "cast(null as string) as last_modified", "cast(null as string) as digest", "cast(null as map<string,string>) as headers")
    wrong = warc.resolve_revisits(rows).where("target_id != record_id - record_id % 500 or state != 'resolved'").count()
    assert wrong == 0


def test_rollup(spark, tmp_path):
    book = rollup.Rollup(spark, str(tmp_path))
    assert book.totals().count() == 0
    rows = spark.createDataFrame([("a", "en", "v", 3), ("a", "en", "v", 4), (None, None, "v", 5)], "source string, lang string, tokenizer string, n_tokens long")
    assert book.commit(1, rollup.inserts(rows)) and not book.commit(1, rollup.inserts(rows))
    book.commit(2, rollup.deletes(rows.where("source is null")).union(rollup.revisions(rows.where("n_tokens = 3").withColumn("x", F.lit(10)), "n_tokens", "x")))
    assert [tuple(r) for r in book.totals().collect()] == [("a", "en", "v", 2, 14)]


def _brute(rows, k=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, odd, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 16)  # so that nodes branch here as well
    rng, rows = random.Random(5), []
    shared = [f"s{i}" for i in range(60)]
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(120)]
        for _ in range(rng.choice([1, 3, 40])):
            w = list(words)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(120)] = f"r{rng.random()}"
            rows.append(" ".join(w))
    rows += [" ".join(shared + [f"u{i}x{j}" for j in range(60)]) for i in range(60)]
    rows += [None, "", "a b", "A  b", "c"]
    docs = list(enumerate(rows))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    few = near_dedup.near_duplicates(odd).collect()
    assert len(few) == 8 and {r.component_id for r in few if r.doc_id == 7} == {4} and near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_blocks_cover_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(near_dedup, "LEVELS", 2)
    monkeypatch.setattr(near_dedup, "HELD", 150)  # so that blocks are cut into chunks
    base = " ".join(f"w{i}" for i in range(80))
    docs = [(i, base + " " + " ".join(f"t{i}n{j}" for j in range(10 + 12 * (i % 2)))) for i in range(40)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in _brute(docs).items()}


def test_agreement_follows_the_threshold(spark):
    assert near_dedup.agreement(0.75) == 168
    base = [f"w{i}" for i in range(404)]
    docs = [(0, " ".join(base)), (1, " ".join(base[:260] + [f"x{i}" for i in range(100)])), (2, "other words of no relation at all")]  # 256 of 500 shingles
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 0.5).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 2}


def test_nodes_draw_their_own_tokens(spark):
    rng = np.random.default_rng(8)
    a = rng.integers(-128, 128, near_dedup.T)
    b = np.where(rng.random(near_dedup.T) < 0.75, a, (a + 129) % 256 - 128)
    sigs = spark.createDataFrame([(b"a", a.tolist()), (b"b", b.tolist())], "cid binary, sig array<int>").withColumn("sig", F.col("sig").cast("array<tinyint>"))
    nodes = spark.range(500).select(F.col("id").alias("node"), F.lit(0).alias("tree"), F.lit(0).cast("long").alias("label"))
    for level in (1, near_dedup.LEVELS - 1):
        rows = near_dedup._children(nodes.crossJoin(sigs), level)
        assert rows.count() == 2000 and rows.distinct().count() == 2000
        met = rows.groupBy("node").count().where("count = 2").count()
        assert 500 < met < 1000  # tokens that all nodes share would give 0, 500 or 1000


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = p.run(spark, SF)
    ids = [r.doc_id for r in out.collect()]
    assert 0.5 * docs.count() < len(ids) == len(set(ids)) <= docs.count()
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
