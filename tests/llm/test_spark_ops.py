"""Every dealt operator and pipeline stage on small tables: nulls, empty and long texts, repeats, odd columns."""

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseloom.llm import decontaminate, entries, extract, language, media, neardup, packing, pii, tokens, urls, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, key string, n string, spans string, term string, pos string"


def docs_of(spark, texts, langs=None, first=0):
    rows = [(None if t == "null id" else first + i, t, (langs or {}).get(i, "en"), "s", None if t is None else len(t), "x", "y", "z", "s", "t", "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def variants(rnd, words, n, changes):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rnd.randint(0, changes)):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(60)}"
        out.append(" ".join(w))
    return out


def slow_components(rows, width, percent):
    sets = {i: naive(t, width) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def naive(text, width):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, width, percent):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = variants(rnd, base, 130, 9) + variants(rnd, [f"v{i}" for i in range(40)], 40, 4)
    texts += [passage + " " + " ".join(f"u{rnd.randrange(9999)}" for _ in range(rnd.randint(5, 60))) for _ in range(60)]
    texts += [" ".join(base[: rnd.randint(60, 120)]) for _ in range(30)] + [texts[0]] * 5
    texts += [None, "", " ", "One", "one", "ONE two", "one two", "long " * 30000]
    rnd.shuffle(texts)
    docs = docs_of(spark, texts).repartition(3)
    docs = docs.unionByName(docs.filter("doc_id in (3, 4)"))
    small, block = neardup.SMALL, neardup.BLOCK
    try:
        for neardup.SMALL, neardup.BLOCK in ((small, block), (3, 25)):
            bands = {"bands": 30, "rows": 6} if percent == 85 else {}
            got = neardup.near_duplicates(docs, width, percent, **bands).collect()
            assert len(got) == len(texts) + 2
            want = slow_components(list(enumerate(texts)), width, percent)
            assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
            assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    finally:
        neardup.SMALL, neardup.BLOCK = small, block


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0
    got = neardup.near_duplicates(docs_of(spark, ["null id", "a b c d e f", None])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, None, True), (1, 1, True), (2, 2, True)}


def slow_contamination(texts, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for item_id, text in items:
            v = words(text)
            n = min(window, len(v))
            for s in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == s:
                        hit.update(range(i, i + n))
                        ids.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination_against_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["a", "b", "the", "É", "x1", "zz", "q"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 5, 13, 14, 30])))) for i in range(25)] + [(99, None), (100, "Only, HERE")]
    texts = [None, "", "...", "only-here", "b"]
    for _ in range(40):
        t = [word() for _ in range(rnd.randint(0, 60))]
        at = rnd.randint(0, len(t))
        texts.append(rnd.choice([" ", ", ", "\n"]).join(t[:at] + (rnd.choice(items)[1] or "").split() + t[at:]))
    texts.append("a " * 20000)
    docs, bench = docs_of(spark, texts), spark.createDataFrame([(i, t, "k") for i, t in items], "item_id bigint, text string, doc_id string")
    got = decontaminate.contamination(docs, bench).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got] == slow_contamination(texts, items)
    kept = {r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()}
    assert kept == {r["doc_id"] for r in got if not r["contaminated"]}
    assert decontaminate.contamination(docs_of(spark, []), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = docs_of(spark, ["x b c a y", "a z z z z z z z z b c", "c b a", "a b c", "b b", "q a a q", "a q a"])
    index = decontaminate.positional_index(docs)
    assert index.count() == 31
    items = spark.createDataFrame([(1, "a b c"), (2, "a a"), (3, "b nowhere")], "item_id int, text string")
    ranked = decontaminate.ranked_terms(decontaminate.phrases(items).select("phrase", "terms"), index, 100)
    for n_bytes in (100, 1 << 40):  # broadcast and shuffled
        got = decontaminate.matches(index, ranked, n_bytes, 3)
        assert {(r["doc_id"], r["phrase"]) for r in got.filter("phrase = 'a b c'").collect()} == {(0, "a b c"), (2, "a b c"), (3, "a b c")}
        assert {(r["doc_id"], r["phrase"], r["start"]) for r in got.filter("exact").collect()} == {(3, "a b c", 0), (5, "a a", 1)}
    out = decontaminate.contamination(docs, items, 3).filter("n_near > 0").collect()
    assert {(r["doc_id"], r["n_items"], r["n_near"]) for r in out if r["doc_id"] in (0, 3)} == {(0, 0, 2), (3, 1, 2)}  # every text with one "a" is near "a a", whose one word it has


ODD = [None, "", " ", "a", "é" * 100, "x " * 60000, "dup", "dup", "null id"]


def test_media_rows(spark):
    got = media.image_features(media.payload_images(docs_of(spark, ODD)))
    for r in got.collect():
        data = (ODD[r["doc_id"] if r["doc_id"] is not None else 8] or "").encode()
        full = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert got.filter("doc_id in (6, 7)").select("media_sha256", "feature").distinct().count() == 1
    assert media.image_features(media.payload_images(docs_of(spark, []))).count() == 0


def test_token_and_identifier_rows(spark):
    public = pytest.importorskip("public_tokenizers")
    got = {r["doc_id"]: r for r in tokens.token_counts(docs_of(spark, ODD), public.path("byte_bpe_50k.json")).collect()}
    assert (got[0]["n_bytes"], got[0]["n_tokens"], got[0]["over_limit"]) == (0, 0, False) and got[5]["over_limit"] and got[4]["n_bytes"] == 200
    whole = __import__("tokenizers").Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    long = ["Long   text's words, " * 20000 + "é\n" * 5000, " ", "<|endoftext|> a" * 3]
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs_of(spark, long), public.path("byte_bpe_50k.json")).collect()}
    assert counts == {i: len(whole.encode(t, add_special_tokens=False)) for i, t in enumerate(long)}
    assert tokens.token_counts(docs_of(spark, []), public.path("byte_bpe_50k.json")).count() == 0
    assert pii.personal_data(docs_of(spark, ODD)).filter("spans = '' and n_email + n_ip + n_card + n_phone = 0").count() == len(ODD)
    out = pii.redacted(docs_of(spark, ["to a@b.cd", None]))
    assert [(r["text"], r["n_chars"]) for r in out.orderBy("doc_id").collect()] == [("to <email>", 10), (None, None)] and out.columns == docs_of(spark, []).columns


def test_language_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs)
    got = language.predict(docs, model).filter(language.held_out())
    n, right = got.count(), got.filter("lang = lang_pred").count()
    assert n and right >= 0.95 * n
    odd = language.predict(docs_of(spark, [None, "", "123 !", "the of and"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd[:3]] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in odd)
    assert language.train(docs_of(spark, [])) is None
    assert language.predict(docs_of(spark, ["a"]), None).first()["lang_pred"] == "und"


def test_packing_spreads_one_key_and_cuts_at_characters(spark):
    docs = docs_of(spark, ["null id"] * 1000)
    got = packing.packed(docs, shard_pieces=100)
    most = got.groupBy("shard").count().agg(F.max("count"), F.count("*")).first()
    assert got.count() == 1000 and most[0] < 250 and most[1] >= 9
    same = packing.packed(spark.createDataFrame([(1, "x", "y")] * 1000, "doc_id int, text string, row string"), shard_pieces=100)
    assert same.groupBy("shard").count().agg(F.max("count")).first()[0] < 250
    text = "aé漢😀" * 60
    parts = packing.packed(docs_of(spark, [text, "b"]), capacities=(32, 64)).filter("doc_id = 0").orderBy("piece").collect()
    data = text.encode()
    assert "".join(data[r["piece_start"] : r["piece_start"] + r["piece_length"]].decode() for r in parts) == text
    assert max(r["piece_length"] for r in parts) <= 63 and [r["piece"] for r in parts] == list(range(len(parts)))
    by_words = packing.packed(docs_of(spark, ["w " * 150]), F.size(F.split("text", " ")), capacities=(64,))
    assert sorted(r["piece_length"] for r in by_words.collect()) == [25, 63, 63]


def test_columns_of_any_name_stay_as_they_are(spark, sf_dir):
    names = ["_kept", "_id", "_key", "_text_key", "_judged", "_letters", "score", "lang_pred", "bits_per_byte", "kept", "component_id", "text_key", "judged_0", "row", "copies", "contaminated"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).cache()
    wide = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("text_key", F.lit("x"))
    stages = {"language": language.recognised, "near": neardup.deduplicated, "bench": lambda d: decontaminate.decontaminated(d, bench), "pii": pii.redacted}
    for stage in stages.values():
        out, plain = stage(wide), stage(docs)
        assert out.columns == wide.columns
        assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in plain.collect()}
        assert all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names)
    told = language.predict(wide.drop("score", "lang_pred", "bits_per_byte"), language.train(docs))
    assert all(r["judged_0"] == f"judged_0{r['doc_id']}" for r in told.collect())
    packed = packing.packed(wide.withColumn("shard", F.lit("s")).withColumn("piece", F.lit("p")))
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_packing_rows(spark):
    got = packing.packed(docs_of(spark, ODD), capacities=(64, 256), shard_pieces=100)
    rows = got.collect()
    assert sum(r["piece_length"] for r in rows) == sum(len((t or "").encode()) for t in ODD)
    assert got.groupBy("shard", "sequence").agg(F.sum(F.col("piece_length") + 1).alias("u"), F.first("sequence_length").alias("c")).filter("u > c").count() == 0
    assert packing.sequences(got).agg(F.sum("n_pieces")).first()[0] == len(rows)
    assert packing.packed(docs_of(spark, [])).count() == 0


PAGES = "page_id bigint, url string, html string, path string, key string, block string, host string"


def test_archive_rows(spark):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://a.b/x", big), (2, "http://a.b/y?q", big), (3, None, None), (4, "odd url", ""), (5, "http://a.b/x", "é" * 700), (6, "HTTP://C.d", "small"), (7, "http://c.d", "small"), (None, "http://e.f/", big), (8, "http://t\tab/\n", "t" * 3000000)]
    pages = spark.createDataFrame([(*r, "p", "k", "b", "h") for r in rows], PAGES)
    archive = warc.write_archive(pages)
    got = {r["page_id"]: r for r in warc.read_records(spark, warc.look_up(pages, warc.write_index(spark, archive))).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        data = (html or "").encode()
        assert (got[page_id]["payload_bytes"], got[page_id]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert (got[1]["record_type"], got[1]["refers_to"]) == ("revisit", 2) and {got[i]["record_type"] for i in (2, 6, 7, None)} == {"response"}
    empty = spark.createDataFrame([], PAGES)
    archive = warc.write_archive(empty)
    assert warc.read_records(spark, warc.look_up(empty, warc.write_index(spark, archive))).count() == 0


def test_no_page_of_an_archive_is_lost(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    monkeypatch.setattr(warc, "DIRECTORY_CHARS", 9)
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    ends = ["\u00a0", "\u3000", "\u0085", "\u2028", " ", "\t", "%20", "\n", "\ufeff", "é"]
    rows = [(i, f"http://same.host/path/{i}{x}", f"<p>{i}</p>") for i, x in enumerate(ends)]
    rows += [(100 + i, "http://same.host/" + "long" * 3000, "z" * (9_000_000 if i == 3 else 1200 + i)) for i in range(12)] + [(200, "http://twice/", "q")] * 3
    spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op5_warc_archive(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == sorted((i, len(h)) for i, _, h in rows)


def test_hot_keys_join_like_others(spark, monkeypatch):
    from caseloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(i % 7 if i % 3 else 1, i) for i in range(90)], "k int, i int")
    few = spark.createDataFrame([(k, f"v{k}") for k in range(6)], "k int, v string")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    hot = common.hot_keys(counts, "k", "n")
    assert [r["k"] for r in hot.collect()] == [1]
    want = {(r["k"], r["i"], r["v"]) for r in rows.join(few, "k").collect()}
    for some in (hot, hot.limit(0), counts.select("k")):
        got = common.joined_hot(rows, few, "k", some)
        assert got.count() == len(want) and {(r["k"], r["i"], r["v"]) for r in got.collect()} == want


def test_hot_templates_are_judged_like_others(spark, monkeypatch):
    from caseloom.llm import common

    pages = spark.createDataFrame([(i, f"http://h{i % 5 % 2}.com/{'bad' if i % 2 else 'good'}/{'/'.join('ab'[: i % 3])}/{i}", "h", "p", "k", "b", "h") for i in range(300)], PAGES)
    marks = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    plain = {tuple(r) for r in urls.filtered(pages, marks).collect()}
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    assert {tuple(r) for r in urls.filtered(pages, marks).collect()} == plain and len(plain) == 300


def test_long_paths(spark):
    path = "/".join("abc"[i % 3] for i in range(20_000))
    rows = [(i, f"http://long.org/{path}/{i}", "h", "p", "k", "b", "h") for i in range(3)] + [(3, f"http://long.org/{path}", "h", "p", "k", "b", "h"), (4, "http://long.org/a", "h", "p", "k", "b", "h"), (5, "http://long.org/" + "/" * 30_000, "h", "p", "k", "b", "h")]
    got = {r["page_id"]: r for r in urls.filtered(spark.createDataFrame(rows, PAGES), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()}
    assert len(got) == 6 and {r["verdict"] for r in got.values()} == {"allow"}
    assert got[3]["template"] == path and got[0]["template"] == got[2]["template"] == path + "/*" and got[5]["template"] == ""


def test_url_rows(spark):
    cases = [(None, "", "", None), ("no scheme", "", "", None), ("http://Example.NET?x", "example.net", "", None), ("http://a.net/b#c", "a.net", "/b", "net/"), ("x://www.example.net/en/1?q", "www.example.net", "/en/1", "example.net/en/"), ("http://myexample.com/de/", "myexample.com", "/de/", None), ("http://example.com/de/", "example.com", "/de/", "example.com/de/"), ("http://a.org/fr/", "a.org", "/fr/", "org/fr/")]
    pages = spark.createDataFrame([(i, c[0], "h", "p", "k", "b", "h") for i, c in enumerate(cases)], PAGES)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = urls.filtered(pages, labels).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in got] == [c[1:] for c in cases]
    assert [r["verdict"] for r in got] == ["allow", "allow", "allow", "block", "allow", "allow", "block", "allow"]
    bad = [(i, f"http://h.com/{'bad' if i % 2 else 'good'}/{i}", "h", "p", "k", "b", "h") for i in range(200)]
    marks = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    got = urls.filtered(spark.createDataFrame(bad, PAGES), marks).collect()
    assert {(r["path"].split("/")[1], r["verdict"]) for r in got} == {("bad", "block"), ("good", "allow")}


def test_extraction_rows(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = extract.train(pages)
    want = lambda h: " ".join(__import__("html").unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", re.search(r"<article>(.*?)(</article>|$)", h, re.S)[1]))).split())
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract.extracted(pages, model).collect():
        assert r["text"] == want(html[r["page_id"]]) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, None, "p", "k", "b", "h"), (2, "u", "", "p", "k", "b", "h")], PAGES)
    assert [(r["text"], r["n_chars"]) for r in extract.extracted(odd, extract.train(odd)).collect()] == [("", 0), ("", 0)]


def held_out_share(spark, sf_dir, change):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = extract.train(pages.filter("page_id % 2 = 0"))
    rest = [r["html"] for r in pages.filter("page_id % 2 = 1").collect()]
    return sum(extract.main_text(change(h), model) == article(h) for h in rest) / len(rest)


def article(h):
    inside = re.search(r"<article>(.*?)(</article>|$)", h, re.S)[1]
    return " ".join(__import__("html").unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", inside))).split())


def test_extraction_without_the_markup_that_labels(spark, sf_dir):
    assert held_out_share(spark, sf_dir, lambda h: h) == 1
    assert held_out_share(spark, sf_dir, lambda h: h.replace("<article>", "<div>").replace("</article>", "</div>")) == 1
    assert held_out_share(spark, sf_dir, lambda h: re.sub("</?article>", "", h)) >= 0.9


def test_extraction_of_empty_tables_and_long_pages(spark, sf_dir):
    empty = spark.createDataFrame([], PAGES)
    assert extract.extracted(empty, extract.train(empty)).count() == 0 and urls.filtered(empty, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0
    model = extract.train(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    long = "<article>" + "<p>" + "some words " * 40 + "</p>" * 3 + "<button>x " * 3000 + "</article>"
    page = spark.createDataFrame([(1, "u", long * 30, "p", "k", "b", "h")] * 2, PAGES)
    assert {r["n_chars"] > 30 * 400 for r in extract.extracted(page, model).collect()} == {True}


def test_pipeline_stages(spark, sf_dir):
    docs = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        after = {r["doc_id"]: r.asDict().get("text") for r in out.collect()}
        if name == "packing":
            assert set(after) == set(before)
            break
        assert out.columns == docs.columns and set(after) <= set(before)
        if name == "language_id":
            model = language.train(docs)
            assert set(after) == {i for i, t in before.items() if t and re.search(r"[^\W\d_]", t) and model.code_lengths([t.encode()]).min() < 8 * language.UNIT * len(t.encode())}
        elif name == "near_dedup":
            comp = slow_components(list(before.items()), 5, 80)
            assert set(after) == {i for i, (_, c) in comp.items() if i == c}
        elif name == "decontaminate":
            marks = dict(zip(before, slow_contamination(before.values(), bench.items())))
            assert set(after) == {i for i, m in marks.items() if not m[-1]}
        elif name == "personal_data":
            assert all(after[i] == pii.redact(t) for i, t in before.items())
        docs = out.cache()
    empty = spark.createDataFrame([], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.QUERIES) == list(range(1, 14))


def test_rows_without_ids_take_no_longer(spark):
    words = lambda i: " ".join(f"w{i * 37 + k}" for k in range(30))
    texts = [words(i // 2) + (" more" if i % 2 else "") for i in range(10_000)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string").repartition(4)
    began = time.time()
    got = neardup.near_duplicates(docs).agg(F.count("*"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (10_000, 10_000) and time.time() - began < 120


def test_one_id_with_many_texts(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(1, a), (5, a + " word"), (5, "quite another text of its own that no one else has here"), (None, a + " word"), (None, "and one more that is like none of the others at all"), (5, None), (5, a + " word")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    answers = {(r["doc_id"], r["text_key"]): r["kept"] for r in neardup.near_duplicates(docs).collect()}
    want = sorted((r for r in rows if not (r[1] or "").endswith(" word")), key=str)
    assert sorted((tuple(r) for r in neardup.deduplicated(docs).collect()), key=str) == want
    assert sum(answers.values()) == len(want) and len(answers) == 6


def test_operators_on_empty_documents(spark, sf_dir):
    none, bench = docs_of(spark, []), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert pii.personal_data(none).count() == 0 and pii.redacted(none).count() == 0
    assert decontaminate.decontaminated(none, bench).count() == 0
    assert language.recognised(none).count() == 0
