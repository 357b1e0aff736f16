"""The ten operators against brute force, and their defined results on odd inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n ", "word", "a b c d e f", "x" * 3000, None, "", "a b c d e f", "né ▁ 😀\n\nend  "]


@pytest.fixture(scope="session")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# --- SQL-checked queries -------------------------------------------------------------


def _compare(spark, name, tables):
    import duckdb

    from riskloom.llm.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')" if tables != SF else f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, tables)
    cols = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(expected)


SQL_CHECKED = ["op1_license_scans", "op4_secret_scans", "op9_quality_rules", "op10_decontamination"]


@pytest.mark.parametrize("name", SQL_CHECKED)
def test_sql(spark, name):
    _compare(spark, name, SF)


@pytest.fixture(scope="session")
def odd_tables(spark, make, tmp_path_factory):
    """Tables of odd rows, short benchmark items and planted findings."""
    top = tmp_path_factory.mktemp("odd")
    long_words = " ".join(f"w{i}" for i in range(40))
    planted = [
        "secret=token: abcdefgh", "Token:'abcdef' AKIA" + "A" * 16 + " " + "0f" * 12, "passwd = ab", "api_key=abcdefgh api_key=xyz1234567",
        "AKIAAKIA" + "Z" * 13 + "é" + "f" * 25 + "\ntoken = \"" + "9a" * 20 + '"',
        long_words, "pre " + " ".join(f"w{i}" for i in range(5, 16)) + " post", "Alpha BETA gamma", "alpha, beta; gamma delta",
        "Released under the MIT License.", "x\nLicensed under CC BY-NC 4.0.\ny", "the same line here\n" * 6, " ".join(["again and again we say it"] * 12),
        "#" * 30 + " a b", "ghp_" + "a1" * 20,
    ]
    make(ODD + planted).write.parquet(f"{top}/documents.parquet")
    items = [(1, long_words), (2, "alpha beta gamma"), (3, None), (4, ""), (5, "alpha beta gamma"), (None, "w3 w4"), (10, "GAMMA")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (3, 0, 0), (4, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


@pytest.mark.parametrize("name", SQL_CHECKED)
def test_sql_on_odd_rows(spark, odd_tables, name):
    _compare(spark, name, odd_tables)


def test_every_query_on_odd_and_empty_tables(spark, odd_tables, tmp_path):
    from riskloom.llm.catalog import QUERIES

    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{odd_tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    n = docs.count()
    vectors = ("op11_", "op12_", "op13_")  # test_vectors has their odd and empty tables
    for name, query in QUERIES.items():
        if name.startswith(vectors):
            continue
        assert query(spark, odd_tables).count() == n, name
        assert query(spark, str(tmp_path)).count() == 0, name


# --- op2 -----------------------------------------------------------------------------


def test_sentencepiece_equals_library_and_round_trips(spark, make, texts):
    import sentencepiece

    from riskloom.llm import sentencepiece_codec as S

    vocabulary, some = S.Vocabulary(), list(texts.values())[:80]
    plain = S.Encoder(vocabulary, 0.0, 0, 1).many(some, [0] * len(some))
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    assert [x.tolist() for x in plain] == library.encode(some)
    docs = make(ODD + some[:10])
    coded = S.encode(docs, seed=3, dropout=0.3, drop_text=False).withColumnRenamed("text", "source_text")
    back = S.decode(coded).collect()
    assert all(r.text == (r.source_text or "") and r.lossless for r in back)
    other = {r.doc_id: r.piece_ids for r in S.encode(docs, seed=4, dropout=0.3).collect()}
    assert any(r.piece_ids != other[r.doc_id] for r in back)
    assert {r.doc_id: r.piece_ids for r in S.encode(docs, seed=3, dropout=0.3).collect()} == {r.doc_id: r.piece_ids for r in back}


def test_sentencepiece_batches_equal_the_heap():
    from riskloom.llm import sentencepiece_codec as S

    v = S.Vocabulary()
    chunks = [" the", " unbelievable", "ñandú😀", "x" * 90, " " * 7, "\n", "▁", " aaaaaaaaabbbbbb", "y" * 300]
    assert [np.frombuffer(b, np.int32).tolist() for b in v.segment_many(chunks, 0.4, 9)] == [v.segment(c, 0.4, 9) for c in chunks]


def test_sentencepiece_repeats_of_a_word_vary(make):
    from riskloom.llm import sentencepiece_codec as S

    v, word = S.Vocabulary(), " unbelievable"
    text = word[1:] + word * 1999
    one, two = (S.Encoder(v, 0.1, 2).many([text], [d])[0] for d in (1, 2))
    assert one.tolist() != two.tolist()
    coder = S.Encoder(v, 0.1, 2)
    salts = coder.salts(1, 2000)
    each = [tuple(v.segment(word, 0.1, int(salt))) for salt in salts]
    assert [i for ids in each for i in ids] == one.tolist()
    assert len(set(each)) > 20
    # the share of runs without a skip is that of independent coins
    turns = v.run(word)[1]
    assert abs(np.mean(S._struck(salts, 0.1) % np.uint64(2**turns) == 0) - 0.9**turns) < 0.04
    # a cache that is emptied all the time, and chunks with more turns than coins drawn ahead
    odd = [text, "x" * 90 + " né▁😀 " + "ab" * 50, " ".join("ñandú😀" for _ in range(300))]
    small = S.Encoder(v, 0.1, 2, 1).many(odd, [1, 2, 3])
    for d, (t, got) in enumerate(zip(odd, small), 1):
        chunks = S._CHUNK.findall(" " + t)
        slow = [i for c, salt in zip(chunks, coder.salts(d, len(chunks))) for i in v.segment(c, 0.1, int(salt))]
        assert got.tolist() == slow and v.decode(slow).decode() == t


def test_sentencepiece_looks_equal_occurrences_up_together():
    from riskloom.llm import sentencepiece_codec as S

    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    v = S.Vocabulary()
    coder = S.Encoder(v, 0.1, 2)
    coder.known = Counted()
    texts = [" the of" * 4000, None, "", "a  b\nc ▁ ñandú😀 " * 700]
    first, again = (coder.many([t or "" for t in texts], [1, 2, 3, 4]) for _ in range(2))
    assert coder.known.asked < 3000  # 15,000 chunks, each time
    for d, (t, got, kept) in enumerate(zip(texts, first, again), 1):
        chunks = S._CHUNK.findall(" " + t) if t else []
        slow = [i for c, salt in zip(chunks, coder.salts(d, len(chunks))) for i in v.segment(c, 0.1, int(salt))]
        assert got.tolist() == kept.tolist() == slow


# --- op3 -----------------------------------------------------------------------------


def _brute_cut(texts, length):
    raw, counts = [(t or "").encode() for t in texts], Counter()
    for b in raw:
        counts.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("max_shard", [20_000, 1])
def test_substring_dedup(make, texts, max_shard):
    from riskloom.llm import substring_dedup as S

    base = "".join(chr(97 + (i * i) % 23) for i in range(900))
    some = ODD + list(texts.values())[:40] + [base, "zz" + base[100:400] + "yy", base[:250] + "q" + base[251:], "ab" * 300, base[50:251], base[51:250]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.cut(make(some), max_shard=max_shard).collect()}
    assert [got[i] for i in range(len(some))] == _brute_cut(some, 200)


# --- op4 -----------------------------------------------------------------------------


def test_ledger_scans_only_what_is_new(spark, make):
    from dataclasses import replace

    from riskloom.llm import secrets as S

    first = S.update(make(["token = abcdefgh", "nothing"]))
    again = S.update(make(["token = abcdefgh", "AKIA" + "B" * 20, "nothing"]), first)
    assert again.seen.count() == 3 * len(S.RULES) and again.findings.count() == 2
    raised = tuple(replace(r, version=2) if r.kind == "hex" else r for r in S.RULES)
    more = S.update(make(["f" * 30, "nothing"]), again, raised)
    assert more.seen.count() == 3 * len(S.RULES) + len(S.RULES) + 1
    assert {r.rule for r in S.current(more, raised).selectExpr("explode(found.kind) AS rule").collect()} == {"assign", "access", "hex"}


def test_redaction_keeps_columns_and_other_text(make):
    from riskloom.llm import secrets as S

    docs = make(["a token = abcdefgh b", None, "clean"])
    out = {r.doc_id: r for r in S.redact(docs).collect()}
    assert out[0].text == "a [secret] b" and out[0].n_chars == 12 and out[1].text is None and out[2].text == "clean"


# --- op5 -----------------------------------------------------------------------------


def _best_fit(sizes, bins, capacity):
    room, out = [capacity] * bins, []
    for size in sizes:
        fits = [b for b in range(bins) if room[b] >= size]
        b = min(fits, key=lambda b: (room[b], b)) if fits else max(range(bins), key=lambda b: (room[b], b))
        room[b] -= size
        out.append(b)
    return sorted(room)


def test_packing_is_best_fit_decreasing():
    from riskloom.llm import sharding as S

    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = sorted(rng.integers(1, 60, 200).tolist(), reverse=True)
        classes = sorted(Counter(sizes).items(), reverse=True)
        runs, _ = S.pack([c for c, _ in classes], [n for _, n in classes], 7, 900)
        room = [900] * 7
        for c, n, b in runs:
            room[b] -= n * classes[c][0]
        assert sorted(room) == _best_fit(sizes, 7, 900)


def test_shards_are_even_gapless_and_keep_groups(spark):
    from riskloom.llm import sharding as S

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = S.assign(docs, n_shards=6).collect()
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.02 * max(load.values())
    text = {r.doc_id: r.text for r in docs.collect()}
    shard_of = defaultdict(set)
    for r in rows:
        shard_of[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())


def test_sizes_stay_exact_beyond_ten_megabytes(spark, make):
    """Every column of the query at 40 shards, with one text in a third of the rows."""
    import zlib

    from riskloom.llm import sharding as S

    rng = np.random.default_rng(9)
    texts = [chr(97 + i % 26) * int(n) + str(i) for i, n in enumerate(rng.integers(1, 14_000, 2000))] + ["copy of one"] * 1000 + [None, ""]
    assert sum(len(t or "") for t in texts) > 10_500_000
    rows = S.assign(make(texts)).collect()
    by_id = {r.doc_id: r for r in rows}
    assert sorted(by_id) == list(range(len(texts))) and len(rows) == len(texts)
    groups, homes, load, slots = Counter(), defaultdict(set), Counter(), defaultdict(list)
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), by_id[i]
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        groups[raw] += r.size
        homes[raw].add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes, share = sorted(groups.values(), reverse=True), -(-sum(groups.values()) // 40)
    assert sorted(load) == list(range(40)) and max(load.values()) - share <= 64
    room = _best_fit(sizes, 40, max(load.values()))
    assert min(room) >= 0 and sorted(max(load.values()) - load[b] for b in range(40)) == room


def test_word_hashes_tell_words_apart():
    from riskloom.llm import quality_rules as Q
    from riskloom.llm import textnum as T

    thue = ["".join("ab"[(i.bit_count() + flip) % 2] for i in range(1024)) for flip in range(2)]
    words = [*thue, "a", "b", "ab", "a" * 8, "a" * 9, "a" * 255, "a" * 256, "a" * 257, "é", "x" * 600 + "y", "x" * 600 + "z", "tail"]
    text = np.frombuffer(" ".join([*words, *words]).encode(), np.uint8)
    starts, ends = T.word_bounds(text)
    for salt in (1, 7, 8, 32):
        h = T.word_hashes(text, starts, ends, salt)
        assert len(set(h[: len(words)].tolist())) == len(words) and (h[: len(words)] == h[len(words) :]).all()
    text = np.frombuffer(f"a b c d e f g {thue[0]} a b c d e f g {thue[1]}".encode(), np.uint8)
    assert Q.repeated_cover(T.word_hashes(text, *T.word_bounds(text))) == 0


# --- op1 -----------------------------------------------------------------------------


def _brute_windows(text, templates):
    from riskloom.llm import license_scan as L

    words, out = re.findall("[a-z0-9]+", (text or "").lower()), []
    for licence, template in templates:
        grams, n = set(L.template_bigrams(template)), len(L.template_words(template))
        good = []
        for at in range(len(words) - 1):
            if f"{words[at]} {words[at + 1]}" not in grams:
                continue
            win = words[at : at + n]
            have = {f"{a} {b}" for a, b in zip(win, win[1:], strict=False)}
            permille = 2000 * len(have & grams) // (len(have) + len(grams))
            if permille >= 800:
                good.append((at, permille))
        for at, p in good:
            if not any(abs(o - at) < n and (q > p or (q == p and o < at)) for o, q in good):
                out.append((at, n, licence, p))
    return sorted(out)


def test_licence_windows(spark, make):
    import textwrap

    from riskloom.llm import license_scan as L

    whole = [(name, t) for name, t in L.TEMPLATES if len(t) > 600]
    wrapped = ["Copyright 2020 Someone\n\n" + "\n".join("# " + x for x in textwrap.wrap(t, 72)) + "\nint main() { return 0; }\n" * 9 for _, t in whole]
    inside = "This module is part of the parser. Licensed under the MIT License. See the docs of the project for the rest of it."
    mit = dict(whole)["MIT"]
    edited = mit.replace("free of charge", "at no cost at all").replace("publish, ", "").replace("TORT", "tort law")
    many = " ".join(["a line of code here", inside] * 60)
    cut = mit[: len(mit) // 2]
    texts = [*ODD, *wrapped, inside, edited, many, cut, "of the " * 400, mit + " " + mit, "permission is hereby granted " * 50]
    docs = make(texts, "doc_id long, text string, _words string, _at0 int, _known string, _near long")
    got = L.window_matches(docs)
    assert got.columns == [*docs.columns, "windows"]
    rows = {r.doc_id: [tuple(w) for w in r.windows] for r in got.select("doc_id", "windows").collect()}
    for i, text in enumerate(texts):
        assert rows[i] == _brute_windows(text, L.TEMPLATES), i
    for i, (name, _) in enumerate(whole, len(ODD)):
        assert name in {w[2] for w in rows[i]}
    at = len(ODD) + len(whole)
    assert {w[2] for w in rows[at]} == {"MIT"} and "MIT" in {w[2] for w in rows[at + 1]} and len(rows[at + 2]) >= 60
    assert "_lines" not in L.matches(docs).columns and L.window_matches(docs.limit(0)).count() == 0


# --- op6 -----------------------------------------------------------------------------


def test_surrogates(make):
    from riskloom.llm import pii as P

    a = "Dear Mr. John Smith, write to john@corp.com or JOHN@CORP.COM, call +1 (017) 555-7713 or +1 017 555 7713; 4111 1111 1111 1111 at 10.2.3.4."
    b = "Mrs Smith met Frau Anna Müller and Господин Иванов; 4111111111111111, 10.2.3.4 and 10.2.3.5"
    out = {r.doc_id: r for r in P.replace(make([a, b, None, "", "clean text", a]), count="n").collect()}
    assert out[2].text is None and out[3].text == "" and out[4].text == "clean text" and out[4].n == 0 and out[0].text == out[5].text
    for piece in ("John", "Smith", "john@", "555", "4111", "10.2.3.4", "Müller", "Иванов"):
        assert piece not in out[0].text + out[1].text
    m = re.search(r"Dear Mr\. (\w+) (\w+), write to (\S+) or (\S+), call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4}); ([\d ]+) at ([\d.]+)\.", out[0].text)
    assert m and m[3].upper() == m[4] and re.sub(r"\D", "", m[5]) == re.sub(r"\D", "", m[6])
    n = re.search(r"Mrs (\w+) met Frau \w+ \w+ and Господин ([А-я]+); (\d+), ([\d.]+) and ([\d.]+)$", out[1].text)
    assert n and n[1] == m[2] and n[3] == m[7].replace(" ", "") and n[4] == m[8] != n[5]
    digits = [int(d) for d in n[3]]
    assert sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2]) in range(0, 200, 10)


def test_surrogates_stay_distinct_in_a_small_space(spark):
    from riskloom.llm import pii as P

    entities = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(45)], "kind string, canon string")
    made = [r.surrogate for r in P.surrogates(entities, rounds=200).collect()]
    assert len(set(made)) == 45 and not set(made) & {f"{i:02d}" for i in range(45)}


def test_names_of_any_length(spark, make):
    from riskloom.llm import pii as P

    texts = [
        "Mr. John Paul Smith met Mrs. Smith.", "Señor Juan de la Cruz spoke, then Sr. Cruz left", "Dr. Anna Weber and Prof. Dr. J. R. van der Berg came.",
        "Mr. Lee Mrs. Kim", "MRS. is no title here, Mr. SMITH is", "Mr. " + " ".join(["Alpha", "Beta"] * 6000), "Mr. Smith de novo", *ODD,
    ]
    docs = make(texts, "doc_id long, text string, _pii_new string, _pii_found int, words string, surface long")
    out = P.replace(docs, count="n")
    assert out.columns == [*docs.columns, "n"] and out.count() == len(texts)
    rows = {r.doc_id: r for r in out.collect()}
    got = [rows[i].text for i in range(len(texts))]
    assert [rows[i].n for i in range(7)] == [2, 2, 2, 2, 1, 1, 1]
    assert got[7:] == ODD
    full = re.fullmatch(r"Mr\. (\w+) (\w+) (\w+) met Mrs\. (\w+)\.", got[0])
    assert full and full[3] == full[4] and len({*full.groups()}) == 3 and not {"John", "Paul", "Smith"} & {*full.groups()}
    cruz = re.fullmatch(r"Señor (\w+) de la (\w+) spoke, then Sr\. (\w+) left", got[1])
    assert cruz and cruz[2] == cruz[3] != "Cruz" and cruz[1] != "Juan"
    berg = re.fullmatch(r"Dr\. (\w+) (\w+) and Prof\. Dr\. ([A-Z])\. ([A-Z])\. van der (\w+) came\.", got[2])
    assert berg and berg[3] != "J" and berg[4] != "R" and berg[3] != berg[4] and not {"Anna", "Weber", "Berg"} & {*berg.groups()}
    assert not re.search("Lee|Kim", got[3]) and got[4] == f"MRS. is no title here, Mr. {full[3].upper()} is"
    assert len(got[5].split(" ")) == 12001 and "Alpha" not in got[5] and got[6] == f"Mr. {full[3]} de novo"


# --- op7 -----------------------------------------------------------------------------


def test_signatures_are_unbiased():
    from riskloom.llm import minhash as M

    rng = np.random.default_rng(7)
    errors = []
    for _ in range(60):
        names = np.sort(rng.integers(1, 2**63, 60).astype(np.uint64))
        x, y = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
        a, b = (names[:50], x[:50]), (names[10:], y[10:])
        errors.append(float((M.bag_minhash(*a) == M.bag_minhash(*b)).mean()) - M.similarity(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


@pytest.mark.parametrize("bounds", [{}, {"DRAWN": 3, "BLOCK_BYTES": 4000, "PART_BYTES": 9000}])
def test_near_duplicate_classes(make, texts, monkeypatch, bounds):
    """The second case cuts small clusters as large ones are cut: drawn centres, several blocks and parts."""
    from riskloom.llm import minhash as M

    for name, value in bounds.items():
        monkeypatch.setattr(M, name, value)
    rng, base = np.random.default_rng(1), [f"w{i}" for i in range(300)]
    family = []
    for k in range(30):
        words = list(base)
        for i in rng.integers(0, 300, k // 3):
            words[i] = f"x{k}_{i}"
        family.append(" ".join(words))
    for k in range(60):  # about 0.65 to 0.9 alike: some apart from all others
        words = list(base[:150])
        for i in rng.integers(0, 150, 2 + k % 5):
            words[i] = f"y{k}_{i}"
        family.append(" ".join(words))
    some = ODD + family + list(texts.values())[:60]
    got = {r.doc_id: r.class_id for r in M.classes(make(some)).collect()}
    sets = [M.shingles(np.frombuffer((t or "").encode(), np.uint8)) for t in some]
    top = list(range(len(some)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(some)):
        for j in range(i):
            if (some[i] or "") == (some[j] or "") or M.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    assert got == {i: find(i) for i in range(len(some))}
    kept = sorted(r.doc_id for r in M.keep_one(make(some)).collect())
    assert kept == sorted({find(i) for i in range(len(some))})


# --- op8 -----------------------------------------------------------------------------


def test_classifier_on_held_out_documents(spark):
    from riskloom.llm import quality_classifier as Q

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels.filter("doc_id % 4 <> 1"))
    assert model.cuts[0] < model.cuts[1]
    rows = Q.score(docs.filter("doc_id % 4 = 1"), model).join(Q.graded(labels), "doc_id").select("grade", "keep", "p_good", "p_not_toxic").collect()
    share = lambda grades: np.mean([r.keep for r in rows if r.grade in grades])
    assert share({2}) > 0.98 and share({1}) < 0.1 and share({0}) < 0.2
    assert all(r.p_not_toxic >= r.p_good for r in rows)


def test_classifier_on_few_labels_and_clashing_names(spark):
    """A few dozen labelled rows: the toxic and poor ones among them go, nearly all good ones stay."""
    from pyspark.sql import functions as F

    from riskloom.llm import quality_classifier as Q

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    absent = labels.withColumn("doc_id", F.col("doc_id") + 10**9)  # labels of absent documents take no place
    model = Q.fit(docs, labels.union(absent), max_fit_rows=labels.count())
    assert np.count_nonzero(model.weights) > 5000
    named = docs.withColumn("score", F.lit("own")).withColumn("keep", F.lit("own"))
    rows = Q.score(named, model).join(Q.graded(labels), "doc_id").select("grade", "score", "_score", "keep", "_keep").collect()
    share = lambda grade: np.mean([r["_keep"] for r in rows if r.grade == grade])
    assert share(0) < 0.1 and share(1) < 0.1 and share(2) > 0.95
    assert {(r.score, r.keep) for r in rows} == {("own", "own")}


def test_classifier_without_labels_keeps_everything(spark, make):
    from riskloom.llm import quality_classifier as Q

    model = Q.fit(make(ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r.keep for r in Q.score(make(ODD), model).collect())


def test_quality_features_reach_the_fit_as_views():
    import pyarrow as pa

    from riskloom.llm import quality_classifier as Q

    rows = [[3, 5], [], [7], [1, 2, 9], []]
    whole = pa.array([[4], *rows, [6, 6]], pa.list_(pa.int32()))
    for lists, want in ((pa.chunked_array([whole.slice(1, 5)]), rows), (pa.chunked_array([whole.slice(1, 2), whole.slice(3, 3)]), rows), (pa.chunked_array([], whole.type), [])):
        assert [r.tolist() for r in Q._rows_of(lists)] == want
    assert len({id(r.base) for r in Q._rows_of(pa.chunked_array([whole]))}) == 1  # one array holds all values


# --- op9 -----------------------------------------------------------------------------


def test_ablation_counts(spark, make):
    from riskloom.llm import quality_rules as R

    ledger = R.ledger(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    rows = ledger.collect()
    for r in R.ablate(ledger, "v2").collect():
        bit, whole = R.mask([r.rule]), R.mask(R.POLICIES["v2"])
        assert r.n_failed == sum(bool(x.fail_bits & bit) for x in rows)
        assert r.n_kept_without == sum(not x.fail_bits & whole & ~bit for x in rows)


# --- pipeline ------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from riskloom.llm import decontaminate, minhash, quality_classifier, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = at, after
        at = after
    for name in list(seen)[:-1]:
        assert seen[name][1].columns == docs.columns
    before, after = seen["quality_classifier"]
    model = quality_classifier.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality_classifier.score(before, model).filter("keep").collect()}
    assert kept == {r.doc_id for r in after.collect()}
    before, after = seen["minhash_near_dedup"]
    assert {r.class_id for r in minhash.classes(before).collect()} == {r.doc_id for r in after.collect()}
    before, after = seen["benchmark_decontamination"]
    report = decontaminate.report(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r.doc_id for r in report.filter("NOT contaminated").collect()} == {r.doc_id for r in after.collect()}
    before, after = seen["secret_scans"]
    assert before.count() == after.count() and secrets.report(after).filter("spans <> ''").count() == 0
    last = seen["sentencepiece"][1]
    assert last.count() == after.count() and last.filter("NOT lossless").count() == 0


def test_near_duplicate_query_keeps_one_row_of_each_class(spark, tmp_path):
    """Equal rows, rows without id, classes of only such rows: exactly one row of each class is kept."""
    from riskloom.llm import minhash

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, "other words here"), (None, "other words here"), (3, None), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = minhash.query(spark, str(tmp_path)).collect()
    assert sorted((r["class_size"], r["kept"]) for r in got) == [(2, False)] * 2 + [(2, True)] * 2 + [(4, False)] * 3 + [(4, True)]
    assert [r["doc_id"] for r in got if r["kept"] and r["class_size"] == 4] == [1]


def test_ledger_scans_only_what_is_new(spark, make):
    """The registered path: an empty ledger, then a stored one; findings of both meet at all paths."""
    from riskloom.llm import secrets as S

    first = make(["token = abcdef123", "nothing", "nothing"])
    ledger = S.update(first)
    assert ledger.seen.count() == 2 * len(S.RULES)
    more = make(["token = abcdef123", "passwd: hunter2hunter2"])
    after = S.update(more, ledger)
    assert after.seen.count() == 3 * len(S.RULES) and after.findings.count() == 2
    assert sorted(r["spans"] for r in S.report(more, ledger=after).collect()) == sorted(r["spans"] for r in S.report(more).collect())
