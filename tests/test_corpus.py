"""Cleaning rules on literal inputs, fingerprints, packing, split and markup."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import pystr
from corpusmill.operators import books, fingerprint, markup, neardup, pages, training
from corpusmill.plans import corpus
from corpusmill.scratch import Scratch


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c"))).first()[0]


def test_python_string_semantics(spark):
    chars = [chr(i) for i in range(1, 0x870) if chr(i).isprintable() or chr(i).isspace() or i < 32]
    df = spark.createDataFrame([(c, f"a{c}b", f"{c}x{c}") for c in chars], "c string, s string, t string")
    got = df.select("c", pystr.words(F.col("s")), pystr.strip(F.col("t")), F.lower("c"), pystr.isdigit(F.col("c"))).collect()
    bad = [r[0] for r in got if r[1] != f"a{r[0]}b".split() or r[2] != f"{r[0]}x{r[0]}".strip() or r[4] != r[0].isdigit()]
    assert bad == []


def test_section_rules(spark):
    assert one(spark, "a--b a---b _x_ [12]", books.clean_section) == "a -- b a---b x"
    assert one(spark, "[note]", books.clean_section) is None
    assert one(spark, "***", books.clean_section) is None
    body = "x\n*** START OF THE PROJECT GUTENBERG EBOOK T ***\r\nbody\n*** END OF THE PROJECT GUTENBERG EBOOK T ***\ny"
    assert one(spark, body, books.strip_marks) == "body" and one(spark, " whole ", books.strip_marks) == "whole"


def test_positional_removal(spark):
    long = "this section has more than eight words in it for sure"
    parts = [long] * 18 + ["ALL CAPITALS HERE AND THERE AND AGAIN OK YES", "see http of " + long, "[half of a remark that is " + long, "the other half]", long, "INDEX to the " + long, long]
    row = books.with_removals(spark.createDataFrame([(parts,)], "sections array<string>")).first()
    assert row.kept == [long] * 18 + ["the other half]", long]
    assert row.rejected[-2:] == ["INDEX to the " + long, long]
    capital = parts[:-2] + ["THE END", long]
    assert books.with_removals(spark.createDataFrame([(capital,)], "sections array<string>")).first().kept[-1] == long  # capitals don't cut


def test_line_flags(spark):
    assert one(spark, "XIV. The end", books.starts_with_roman) and not one(spark, "I went", books.starts_with_roman)
    assert one(spark, "see page 12", books.ends_with_number) and not one(spark, "", books.ends_with_number)
    assert one(spark, "write to a.b@c.org now", books.has_email)
    assert one(spark, "A, 1770-1850; B, 1880-1950", books.early_author) and not one(spark, "A, 1880-1950", books.early_author)
    assert one(spark, None, books.early_author) is False and one(spark, "A, 1850-", books.early_author) is False


def test_catalog(spark):
    cat = spark.createDataFrame([(1, "Text", "en", "A, 1770-1850"), (2, "Sound", "en", "A, 1770-1850"), (3, "Text", "en; fr", "A, 1770-1850"), (4, "Text", "en", None)], "`Text#` int, Type string, Language string, Authors string")
    found = spark.createDataFrame([(1,), (4,), (9,)], "book_id int")
    assert [r[0] for r in books.books_in_catalog(found, cat).collect()] == [1]
    assert tuple(books.catalog_totals(found, cat).first()) == (4, 1, 3, 1)


def test_scan_lines(spark):
    assert one(spark, "THE HEAD", pages.scan_line) is None
    assert one(spark, "ab 12 the longer part of it", pages.scan_line) == "the longer part of it"
    assert one(spark, "PAGE HEAD then text ^x »y", pages.scan_line) == "then text y"
    assert one(spark, ["one two", "two three", "three"], pages.without_catchwords, "array<string>") == ["one", "two", "three"]


def test_scan_books_need_english_first_record(spark):
    rows = [("f", i, i, "T", {"Language_1": "English" if i else "French"}, False, f"p{i}", None) for i in range(3)]
    rows += [("g", i, 10 + i, "T", {"Language_1": "English"}, False, f"p{i}" if i != 1 else None, None) for i in range(3)]
    df = spark.createDataFrame(rows, "file_name string, rec_idx int, rec_id bigint, title string, language_map map<string,string>, multi_language boolean, text string, loaded_at timestamp")
    got = pages.assemble_scans(df, min_pages=2).collect()
    assert [(r.file_name, r.n_pages, r.text) for r in got] == [("g", 2, "p0\np2")]


def test_news_sentences(spark):
    s = "one two three four five six seven eight"
    text = "\n".join([s, s + " again", "too short", "A B C D E F G H I", "x x x x x a b c", "leaders ....... in a line of more than eight words", "other words that are good enough to be kept here"])
    got = pages.clean_segments(spark.createDataFrame([(text,), (None,), ("",)], "content string")).collect()
    assert got[0].sentences == [s, "other words that are good enough to be kept here"] and got[1].sentences == [] and got[2].sentences == []


def test_articles(spark):
    nine = "a b c d e f g h i"
    text = "\n".join([f" {nine} ", "a b c d e f g h", nine, nine.upper() + " J", nine + " j"])
    row = pages.clean_articles(spark.createDataFrame([(text,)], "text string"), min_lines=2, min_words=10).first()
    assert row.lines == [nine, nine + " j"] and row.big_enough
    assert spark.range(1).select(pages.article_name("x", F.lit(1234567))).first()[0] == "x-1234567"


def test_simhash_against_plain_python():
    import hashlib

    rng = random.Random(1)
    lists = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 20))] for _ in range(40)]
    for ws, h in zip(lists, fingerprint.simhash64(lists)):
        total = [0] * 64
        for w in ws:
            v = int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
            for i in range(64):
                total[i] += 1 if v >> i & 1 else -1
        assert int(np.uint64(h.astype(np.uint64))) == sum(1 << i for i in range(64) if total[i] >= 0)


def test_bands_and_hex(spark):
    assert fingerprint.band_widths(5) == [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)] and fingerprint.max_distance(0.85) == 9
    with pytest.raises(ValueError):
        fingerprint.max_distance(0)
    df = spark.createDataFrame([(v,) for v in (0, -1, 5, -(2**63), 2**63 - 1)], "h bigint")
    for h, x, back in df.select("h", fingerprint.to_hex(F.col("h")), fingerprint.from_hex(fingerprint.to_hex(F.col("h")))).collect():
        assert int(x, 16) == h % 2**64 and back == h


def test_oversized_buckets_lose_no_pair(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    hs = [base]
    for _ in range(120):
        h = rng.choice(hs)
        for _ in range(rng.randint(0, 4)):
            h ^= 1 << rng.randrange(64)
        hs.append(h)
    rows = [(i, 1, h - 2**64 if h >= 2**63 else h, str(i)) for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "doc_id bigint, chars int, simhash bigint, sha1 string")
    plain = sorted(map(tuple, neardup.candidate_pairs(df).collect()))
    assert plain == sorted(map(tuple, neardup.candidate_pairs(df, max_bucket=3).collect())) and plain


def test_large_buckets_find_pairs_that_differ_in_every_other_part(spark):
    old = [range(i * 64 // 10, (i + 1) * 64 // 10) for i in range(10)]
    rows, want, rng = [], set(), random.Random(5)
    for band in range(4):
        shared = range(16 * band, 16 * band + 16)
        outside = [[b for b in part if b not in shared] for part in old]
        outside = [part for part in outside if part]
        for distance in (8, 9):
            for _ in range(20):
                flips = [rng.choice(part) for part in outside[:distance]]
                flips += rng.sample([b for b in range(64) if b not in shared and b not in flips], distance - len(flips))
                x = rng.getrandbits(64) & ~(0xFFFF << 16 * band)  # all in one bucket of the band
                y = x
                for b in flips:
                    y ^= 1 << b
                want.add((len(rows), len(rows) + 1, distance))
                rows += [(len(rows), x), (len(rows) + 1, y)]
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in rows]
    df = spark.createDataFrame(signed, "doc_id bigint, simhash bigint")
    got = set(map(tuple, neardup.candidate_pairs(df, max_bucket=3).collect()))
    assert want <= got and got == set(map(tuple, neardup.candidate_pairs(df).collect()))
    for n_bands in (1, 2, 3):
        few = df.where("doc_id < 40")
        assert sorted(map(tuple, neardup.candidate_pairs(few, 0.3, n_bands, 1).collect())) == sorted(map(tuple, neardup.candidate_pairs(few, 0.3, n_bands).collect()))


def _prints(seed, n):
    """Fingerprints in few buckets, some ids with several of them, repeated rows and a null id; and their pairs by brute force."""
    rng = random.Random(seed)
    hs = [rng.getrandbits(64)]
    while len(hs) < n:
        h = rng.choice(hs[:20])
        for _ in range(rng.randint(0, 7)):
            h ^= 1 << rng.randrange(64)
        hs.append(h)
    rows = list(enumerate(hs)) + [(3, hs[9]), (3, hs[11]), (4, hs[4] ^ 1), (5, hs[5])]
    want = set()
    for a, x in rows:
        for b, y in rows:
            d = (x ^ y).bit_count()
            if a < b and d <= 9 and any((x ^ y) >> at & 0xFFFF == 0 for at in (0, 16, 32, 48)):
                want.add((a, b, d))
    return [(i, h - 2**64 if h >> 63 else h) for i, h in [*rows, (None, hs[0])]], want


@pytest.mark.parametrize("max_bucket", [2500, 16])
def test_candidate_pairs_equal_brute_force(spark, max_bucket):
    rows, want = _prints(31, 300)
    got = neardup.candidate_pairs(spark.createDataFrame(rows, "doc_id bigint, simhash bigint"), max_bucket=max_bucket).collect()
    assert len(got) == len(want) > 1000 and set(map(tuple, got)) == want


@pytest.mark.parametrize("max_bucket", [2500, 16])
def test_pair_degrees_count_the_pairs(spark, max_bucket):
    rows, want = _prints(32, 300)
    df = spark.createDataFrame(rows, "doc_id bigint, simhash bigint")
    got = neardup.pair_degrees(df, max_bucket=max_bucket, near=4).collect()
    assert sorted(r.doc_id for r in got) == sorted({i for p in want for i in p[:2]})
    assert (sum(r.n_pairs for r in got), sum(r.n_near for r in got)) == (len(want), sum(d <= 4 for *_, d in want))
    assert min(r.least for r in got if r.n_pairs) == min(d for *_, d in want) and all(r.least is None for r in got if not r.n_pairs)
    assert neardup.pair_degrees(df.where("false")).collect() == []


def test_match_statistics_make_no_pairs(spark, tmp_path):
    spark.createDataFrame([(i, f"{'word ' * 60}{i}") for i in range(8)] + [(9, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus.match_statistics(spark, str(tmp_path))
    assert got.first().n_docs == 8 and got.first().n_pairs == corpus.near_dup_matches(spark, str(tmp_path)).count() == 28
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_candidate_pairs_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id bigint, simhash bigint")
    for prints in (df, df.where("false")):
        pairs = neardup.candidate_pairs(prints)
        assert pairs.count() == len(set(map(tuple, pairs.collect()))) == (36 if prints is df else 0)
        above = pairs._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
        assert "Aggregate" not in above and "Join" not in above


def test_simhash_of_long_texts(spark):
    rng = random.Random(8)
    lists = [[rng.choice("abc") for _ in range(n)] for n in (0, 1, 254, 255, 256, 510, 511, 0, 3000)]
    for ws, h in zip(lists, fingerprint.simhash64(lists)):
        each = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in ws]
        assert int(h) % 2**64 == sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in each) >= len(ws))


def test_near_duplicates_end_to_end(spark):
    rng = random.Random(3)
    w = [f"word{i}" for i in range(400)]
    text = " ".join(rng.choices(w, k=200))
    docs = spark.createDataFrame([(1, text, "a"), (2, text.upper(), "b"), (3, text + " end", "a"), (4, " ".join(rng.choices(w, k=200)), "a"), (5, None, "a"), (6, "", "a")], "doc_id bigint, text string, source string")
    left = {r.doc_id for r in neardup.deduplicated(docs, Scratch(spark, "t")).collect()}
    assert left == {3, 4, 5, 6}


def _shingles(text, n):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def _variants(rng, n_texts, length):
    w = [f"word{i}" for i in range(60)]
    texts = []
    for _ in range(n_texts):
        t = rng.choices(w, k=length)
        texts.append(" ".join(t))
        for k in (1, 3, 6):
            u = list(t)
            for i in rng.sample(range(length), k):
                u[i] = rng.choice(w)
            texts.append(" ".join(u + ["and more"] * rng.randint(0, 1)))
    return texts


@pytest.mark.parametrize("how", [{"jaccard": 0.8}, {"containment": 0.9}])
def test_similar_pairs_equal_brute_force(spark, how):
    rng = random.Random(21)
    texts = _variants(rng, 12, 80) + ["a b c d e f g h", "a b c d e f g h i", "a b", ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None)], "doc_id bigint, text string")
    own = neardup.shingles(docs, 5).where(F.size("s") > 0)
    got = {(r.a, r.b): r.i for r in neardup.similar_pairs(own, Scratch(spark, "t"), **how).collect()}
    want = {}
    sets = [_shingles(t, 5) for t in texts]
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            i = len(sets[a] & sets[b])
            whole = len(sets[a] | sets[b]) if "jaccard" in how else min(len(sets[a]), len(sets[b]))
            if whole and i >= list(how.values())[0] * whole - 1e-9:
                want[(a, b)] = i
    assert got == want and len(want) > 10


def test_near_duplicate_classes(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (9, base.upper() + "!!"), (7, base + " end"), (3, "short text"), (2, "Short  text"), (1, None), (4, None), (6, ""), (8, " "), (7, base + " end")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, class_id int")
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.near_duplicate_classes(docs, Scratch(spark, "t")).collect()}
    assert got[3] == got[2] == (2, 0) and got[1] == (1, 0) and got[4] == (4, 0) and got[6] == got[8] == (6, 0)
    assert got[5][0] == got[7][0] == 5 and got[7][1] == 2 and got[9][0] == 5  # "!!" stays in the normal form, so it is another text
    assert neardup.near_duplicate_classes(docs.where("false"), Scratch(spark, "t")).collect() == []


def test_accepted_pairs_are_those_of_all_scored_candidates(spark):
    rng = random.Random(22)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(_variants(rng, 15, 150))] + [(900, None)], "doc_id bigint, text string").cache()
    prints = fingerprint.fingerprint(docs).cache()
    cols = ["a", "b", "distance", "len_shingles_a", "len_shingles_b", "word_shingle_jaccard"]
    want = neardup.score_pairs(neardup.candidate_pairs(neardup.representatives(prints)), docs).select(cols).collect()
    got = neardup.accepted_pairs(prints, docs, Scratch(spark, "t")).select(cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and want
    rows = neardup.match_rows(got, prints, ("chars", "sha1")).collect()
    assert len(rows) == len(want) and rows[0].chars_a > 0 and rows[0].sha1_a != rows[0].sha1_b


def test_accepted_counts_score_no_pairs(spark, tmp_path):
    rng = random.Random(23)
    texts = _variants(rng, 12, 150) + ["a " * 150, "b " * 150, " ".join("cdefg" * 30)]
    few = ["x" * 250 + f" {i}" for i in range(3)]  # fewer than ten shingles
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:2], *few])] + [(900, None)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    prints = fingerprint.fingerprint(docs)
    scored = neardup.score_pairs(neardup.candidate_pairs(neardup.representatives(prints)), docs, jaccard=0.0, containment=0.0)
    modes = ("jaccard", "containment", "both", "either")
    want = scored.agg(F.count(F.lit(1)), *[F.count_if(neardup.accepted(m, 0.9, 0.95)) for m in modes]).first()
    got = corpus.accepted_counts(spark, str(tmp_path))
    assert tuple(got.first()) == tuple(want) and got.columns == ["n_scored", *(f"n_{m}" for m in modes)]
    assert want[0] > want[4] > want[3] >= 0 and "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_content_hashes_and_status(spark):
    docs = spark.createDataFrame([(1, "word " * 60), (2, "WORD " * 60), (3, "short"), (4, None), (5, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.sha1 for r in fingerprint.content_hashes(docs).collect()}
    assert set(got) == {1, 2} and got[1] == got[2] == {r.doc_id: r.sha1 for r in fingerprint.fingerprint(docs).collect()}[1]
    assert {r.status: r.n for r in fingerprint.status_counts(docs).collect()} == {"ok": 2, "too_short": 2, "unreadable": 1}


def test_exclusions_stages_and_lines(spark):
    docs = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "path string, n int")
    assert sorted(r.n for r in neardup.without_excluded(docs, spark.createDataFrame([("b",), (None,), ("b",)], "path string")).collect()) == [1, 2]
    stages = {r.block: r.stage for r in training.staged(spark.range(10).withColumnRenamed("id", "block"), [0.25, 0.5, 0.25]).collect()}
    assert [stages[i] for i in range(10)] == [0, 0, 1, 1, 1, 1, 1, 2, 2, 2]
    assert one(spark, "a\r\nb\nc\rd", training.without_newlines) == "a b c d"


def test_blocks_in_keyed_order(spark):
    seqs = [(i, [i] * (i % 5), "f") for i in range(60)]
    df = spark.createDataFrame([*seqs, (None, [1], "f")], "seq_id bigint, input_ids array<int>, file_name string")
    out = training.pack_blocks(training.in_keyed_order(df, 7), 5).orderBy("block").collect()
    import hashlib

    flat = [x for i, ids, _ in sorted(seqs, key=lambda s: hashlib.md5(f"7:{s[0]}".encode()).hexdigest()) for x in ids]
    assert [x for r in out for x in r.input_ids] == flat[: len(flat) // 6 * 6]


def test_tokenizer_files(spark):
    file = f"{training.TOKENIZERS}/byte_bpe_50k.json"
    pytest.importorskip("tokenizers")
    docs = spark.createDataFrame([(1, "The house, <|endoftext|> é"), (2, None), (3, "")], "doc_id bigint, text string")
    end = training.special_ids(file)[training.END_OF_TEXT]
    got = {r.doc_id: list(r.ids) for r in training.encode(docs, file, end=end).collect()}
    assert got[2] == got[3] == [50256] and got[1][-1] == 50256 and 50256 not in got[1][:-1]
    assert all(r.same for r in training.round_trip(docs, file).collect())
    assert training.special_ids(file)["<unk>"] == 50257 and training.check_vocabulary(file, 50257) == 50257
    with pytest.raises(ValueError):
        training.check_vocabulary(file, 32000)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from corpusmill.scratch import shared_folder

    conf = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="yarn"))
    with pytest.raises(RuntimeError):
        shared_folder(far)
    s = Scratch(spark, "t")
    a = s.save(spark.range(3))
    assert a.count() == 3
    s.drop(a)
    with pytest.raises(Exception):
        spark.read.parquet(a._scratch_path)


def test_catalog_markup_and_resumed_files(spark, tmp_path):
    from corpusmill.sources import readers, writers

    (tmp_path / "c.csv").write_text('Text#,Type,Issued,Title,Language,Authors,Subjects,LoCC,Bookshelves\n1,Text,x,"A ""title""\nin two lines",en,"A, 1770-1850",s,l,b\n')
    assert readers.catalog(spark, str(tmp_path / "c.csv")).first().Title == 'A "title"\nin two lines'
    for name in ("b.txt", "a.txt"):
        (tmp_path / "cache" / "epub" / "12").mkdir(parents=True, exist_ok=True)
        (tmp_path / "cache" / "epub" / "12" / name).write_text(name)
    files = readers.text_files(spark, str(tmp_path / "cache"))
    assert [(r.book_id, r.text) for r in readers.first_files(files).collect()] == [(12, "a.txt")]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "OBC2POS-1.xml").write_text("<p/>")
    (tmp_path / "x" / "t.xml").write_text("<a><p>One</p></a>")
    assert [r.path.rpartition("/")[2] for r in readers.markup_files(spark, str(tmp_path / "x")).collect()] == ["t.xml"]
    df = spark.createDataFrame([(1, 'say "x",\ny', None)], "id int, s string, z string")
    writers.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).first().s == 'say "x",\ny'
    writers.write_jsonl(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json"), schema=df.schema).first() == df.first()
    rows = spark.createDataFrame([([1, 2], ["f"])], "input_ids array<bigint>, file_names array<string>")
    writers.write_packed(rows, str(tmp_path / "packed"))
    with pytest.warns(UserWarning, match="no splits"):
        assert readers.packed_rows(spark, str(tmp_path / "packed"), "train").schema["input_ids"].dataType.elementType.simpleString() == "int"
    with pytest.raises(Exception, match="exist"):
        writers.write_packed(rows, str(tmp_path / "packed"))
    docs = spark.createDataFrame([(1, "word " * 60)], "doc_id bigint, text string")
    assert readers.saved_prints(spark, str(tmp_path / "fp"), 200) is None
    first = readers.resumed_prints(spark, str(tmp_path / "fp"), docs).first()
    assert readers.resumed_prints(spark, str(tmp_path / "fp"), docs.where("false")).first() == first and readers.saved_prints(spark, str(tmp_path / "fp"), 100) is None
    assert readers.parquet_columns(spark, str(tmp_path / "fp" / "min_chars=200"), ["sha1"]).columns == ["sha1"]
    (tmp_path / "run.json").write_text('{"seed": 1}')
    assert readers.config(str(tmp_path / "run.json")) == {"seed": 1}
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(ValueError):
        readers.config(str(tmp_path / "bad.json"))


def test_issues(spark):
    s = "one two three four five six seven eight nine"
    rows = [(i, "i1", 1, 1, 1, 10 - i, "text", f"{s} {i}", None) for i in range(10)] + [(20, "i2", 1, 1, 1, 1, "text", s, None), (21, None, 1, 1, 1, 1, "text", s, None), (22, "i1", 1, 1, 1, 0, "advert", s, None)]
    df = spark.createDataFrame(rows, "seg_id bigint, issue_id string, page_number int, block_no int, col_no int, reading_order int, seg_class string, content string, loaded_at timestamp")
    lines = pages.issue_lines(df)
    sizes = pages.issue_sizes(lines, 5, 20)
    assert [tuple(r) for r in sizes.collect()] == [("i1", 10, 100)]
    got = pages.assemble_issues(lines, sizes, 100).first()
    assert got.text.split("\n") == [f"{s} {i}" for i in range(9, -1, -1)] and pages.assemble_issues(lines, sizes, 9).collect() == []
    assert one(spark, "x", lambda c: pages.issue_name(c, F.lit(7))) == "x_article-7"


def test_split_counts_are_exact(spark):
    rows = [(i, "big" if i < 950 else "small" if i < 990 else None) for i in range(1000)]
    got = training.stratified_split(spark.createDataFrame(rows, "doc_id bigint, source string"), percent=2)
    n = {(r.source, r.split): r.n_docs for r in training.split_counts(got).collect()}
    assert n[("big", "val")] == 19 and n[("small", "val")] == 1 and n[(None, "val")] == 1 and sum(n.values()) == 1000
    few = spark.createDataFrame([*rows, (None, "big")], "doc_id bigint, source string")
    assert {(r.source, r.split): r.n_docs for r in training.split_counts(training.stratified_split(few, percent=2, digits=1)).collect()} == n | {("big", "train"): n[("big", "train")] + 1}
    assert training.stratified_split(few.where("false")).collect() == []


def test_split_of_the_shipped_list(spark):
    # How many files of each source a split of one percent has.
    shipped = {"blbooks": 269, "gutenberg": 377, "ncse_v2_revised": 1, "old_bailey": 5, "post-ocr-correction": 310}
    sizes = {"blbooks": 26950, "gutenberg": 37799, "ncse_v2_revised": 90, "old_bailey": 520, "post-ocr-correction": 31000}
    parts = [spark.range(n).select(F.format_string(f"{s}-%d", "id").alias("doc_id"), F.lit(s).alias("source")) for s, n in sizes.items()]
    docs = parts[0]
    for p in parts[1:]:
        docs = docs.union(p)
    n = {r.source: r.n_docs for r in training.split_counts(training.stratified_split(docs)).where("split = 'val'").collect()}
    assert n == shipped and sum(n.values()) == 962


def test_deep_markup_has_no_limit():
    import xml.etree.ElementTree as ET

    e = ET.fromstring("<p>" + "<a>x" * 5000 + "</a>y" * 5000 + "</p>")
    assert markup.visible_text(e) == "x" * 5000 + "y" * 5000


def test_blocks_are_the_sequence_of_all_ids(spark):
    rng = random.Random(4)
    seqs = [(i, [rng.randint(0, 99) for _ in range(rng.choice([0, 1, 5, 30]))], f"f{i % 3}") for i in range(40)]
    df = spark.createDataFrame([*seqs, seqs[3], (99, None, "f")], "seq_id bigint, input_ids array<int>, file_name string")
    out = training.pack_blocks(df, 6).orderBy("block").collect()
    flat = [x for _, ids, _ in seqs for x in ids]
    assert [x for r in out for x in r.input_ids] == flat[: len(flat) // 7 * 7]
    assert training.pack_totals(df, 6).first().n_blocks == len(out)
    assert training.validate_rows(training.pack_blocks(df, 6), 6).first().valid
    assert not training.validate_rows(training.pack_blocks(df.where("false"), 6), 6).first().valid
    row = training.shifted(training.pack_blocks(df, 6), 6).orderBy("block").first()
    assert row.inputs == flat[:6] and row.labels == flat[1:7] and row.attention_mask == [1] * 6
    with pytest.raises(Exception, match="row length"):
        training.shifted(spark.createDataFrame([([1, 2],)], "input_ids array<int>"), 6).collect()


def test_markup(spark):
    xml = b'<TEI xmlns="x"><text><body><div1 type="trialAccount"><p>One <rs>two</rs> three <interp>no</interp>four .</p></div1><div1 type="front"><p>gone</p></div1></body></text></TEI>'
    df = spark.createDataFrame([("d/a.xml", bytearray(xml)), ("d/OBC2POS-a.xml", bytearray(xml)), ("d/b.xml", bytearray(b"<p>"))], "path string, content binary")
    got = {r.path: r for r in markup.extract_markup(df).collect()}
    assert got["d/a.xml"].text == "One two three four.\n" and set(got) == {"d/a.xml", "d/b.xml"} and got["d/b.xml"].text is None and got["d/b.xml"].error
    assert "gone" in markup.extract_markup(df, trials_only=False).where("path = 'd/a.xml'").first().text


def test_readers_and_writers(spark, tmp_path):
    from corpusmill.sources import readers, writers

    root = tmp_path / "root"
    (root / "s").mkdir(parents=True)
    (root / "s" / "a.txt").write_bytes(b"ok\xff\r\nline")
    (root / "s" / "b.jsonl").write_text('{"title": "T"}\n\n{"title": "U"}\n')
    got = readers.text_files(spark, str(root)).first()
    assert got.source == "s" and got.text == "ok�\r\nline"
    assert readers.text_files_lossy(spark, str(root)).first().text == "ok\nline"
    assert [(r.rec_idx, r.title) for r in readers.json_records(spark, str(root), "title string").collect()] == [(0, "T"), (2, "U")]
    with pytest.raises(FileNotFoundError):
        readers.text_files(spark, str(tmp_path / "none"))
    df = spark.createDataFrame([([1, 2], ["f"], "train", "a")], "input_ids array<int>, file_names array<string>, split string, name string")
    writers.write_corpus(df, str(tmp_path / "t"), ("split",))
    assert readers.packed_rows(spark, str(tmp_path / "t"), "train").count() == 1
    with pytest.raises(ValueError):
        readers.packed_rows(spark, str(tmp_path / "t"), "val")
    writers.export_texts(df.selectExpr("name", "split as text"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a").read_text() == "train"


def test_chat_and_stream(spark, tmp_path):
    from corpusmill.streaming.rowlocal import fingerprint_stream, stream_table

    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "conv_id bigint, turn int, role string, text string")
    assert training.render_chat(turns).first().rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    docs = spark.createDataFrame([(1, "word " * 100)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = fingerprint_stream(stream_table(spark, str(tmp_path / "in"), docs.schema), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_entry_has_sql_for_most_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and {"dedup_corpus", "packed_blocks"} <= set(e.queries())
