import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curatrix.llm import lines, minhash, mixing, neighbours, pieces, pii, quality, queries, secrets, store, toxicity
from curatrix.sources import tables
from tests.compare import check

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rate double, key string, score double, places string, line string, label int"
LONG = "the quick brown fox jumps " * 30000


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 1.0, "k", 0.5, "p", "l", 1) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long, repeated and tied rows beside clashing columns."""
    return frame(spark, [(None, "null id has a text of some words here", "a"), (1, None, "a"), (2, "", None), (3, LONG, "b"), (4, "again and again the same line of words\nx", "b"), (4, "again and again the same line of words\nx", "b"), (5, "again and again the same line of words\ny", None)]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, []).cache()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    check(spark, SF, queries.QUERIES[name], queries.SQL[name])


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# 1


def plain_pii(t):
    out = []
    for k, rx in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(rx, t):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if (True, k == 1 and max(map(int, m.group().split("."))) < 256 if k == 1 else True, 13 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15)[k]:
                out.append((k, m.start(), m.end()))
    return out


def test_pii_base_is_the_plain_search():
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice(rng.choice(["ab@.-c1@ _%", "0123456789 -.", "+0123456789 ().-", "12.255.0 "])) for _ in range(rng.randrange(50)))
        assert pii.base_spans(t) == plain_pii(t), t


def test_pii_adds_what_the_labelers_agree_on(spark, odd, none):
    rows = [(i, f"email: u{i}@mail.example.com and card 4111 1111 1111 1111", "a") for i in range(200)] + [(200 + i, f"say u{i}@mail.example.com", "a") for i in range(100)]
    rows += [(300 + i, f"my email: j{i}.doe at example dot com and", "a") for i in range(60)] + [(400 + i, f"she sat at noon dot and x at y dot zz{i} now", "a") for i in range(60)]
    got = {r.doc_id: r for r in pii.digest(pii.spans(frame(spark, rows))).collect()}
    assert all(got[i].n_email == 1 and got[i].n_card == (i < 200) for i in range(300))
    assert all(got[i].n_email == 0 and got[i].spans.startswith("email:10:") for i in range(300, 360)) and all(got[i].spans == "" for i in range(400, 460))
    assert pii.digest(pii.spans(odd)).count() == 7 and pii.digest(pii.spans(none)).count() == 0


def test_pii_searches_every_loose_form():
    assert [x[:3] for x in pii.candidates("email: jane at example.com")] == [(0, 7, 26)]
    assert [x[:3] for x in pii.candidates("4111/1111/1111/1111, so")] == [(2, 0, 19)]


def test_pii_query_on_documents(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op1_pii(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in got} == set(text) and len(got) == len(text)
    for r in got:
        want = plain_pii(text[r.doc_id] or "")
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_pii_spans_apart():
    long = "a" * 90 + "@" + "b" * 300 + ".com"
    text = f"call +49 170 123456789 or mail {long} or {'c' * 80} at {'d' * 70} dot org"
    found = pii.candidates(text)
    assert [x[0] for x in found] == [0, 3, 0] and text[found[2][1] : found[2][2]].startswith("ccc") and text[found[2][1] : found[2][2]].endswith("dot org")
    ends = sorted(x[1:3] for x in found)
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_pii_obfuscated_spans_recall_and_precision(spark):
    rng = random.Random(12)
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 9)))
    rows, planted = [], {}
    for i in range(400):
        rows.append((i, f"{name()} email: {name()}@{name()}.com and phone +1 202 555 0{100 + i % 100} then {name()}", "a"))
    for i in range(400, 600):
        head = f"{name()} {name()} please email: "
        span = (f"{name()} at {name()} dot com", f"{name()}(at){name()}.org", f"{name()} [at] {name()} [dot] net")[i % 3]
        rows.append((i, head + span + f", {name()}", "a"))
        planted[i] = f"email:{len(head)}:{len(head) + len(span)}"
    rows += [(i, f"{name()} met {name()} at {name()} dot {name()} over 12/34/5678 {name()}", "a") for i in range(600, 800)]
    got = {r.doc_id: r.spans for r in pii.digest(pii.spans(frame(spark, rows))).collect()}
    assert sum(got[i] == x for i, x in planted.items()) >= 0.9 * len(planted)
    assert sum(got[i] != "" for i in range(600, 800)) <= 10


def test_em_tells_reliable_labelers():
    counts = np.zeros(32)
    counts[0b01111], counts[0b00000], counts[0b01000], counts[0b10000] = 500, 100, 300, 200
    prior, hit, false, post = pii.em(counts)
    assert 0.3 < prior < 0.7 and hit[0] > 0.95 and false[0] < 0.1 and post[0b01111] > 0.9 and post[0b11000] < 0.1


# 2


def test_bagminhash_is_unbiased():
    rng, off = np.random.default_rng(0), []
    for _ in range(200):
        h = rng.integers(0, 2**63, 60).astype(np.uint64)
        x = rng.integers(0, 6, 60)
        y = np.where(rng.random(60) < 0.7, x, rng.integers(0, 20, 60))
        a, b = (minhash.signature(h[w > 0], w[w > 0]) for w in (x, y))
        off.append((a == b).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(off)) < 0.015


def near_classes(rows):
    """Classes by comparing all pairs."""
    bags = {i: minhash.multiset(minhash._WORD(t or "")) for i, t in rows.items()}
    up = {i: i for i in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(bags[a][0]) and len(bags[b][0]) and minhash.overlap(bags[a], bags[b]) >= minhash.SIMILAR:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in rows}


def test_near_classes_are_those_of_all_pairs(spark, odd, none):
    got = {r.doc_id: r.class_id for r in queries.op2_near_duplicates(spark, SF).collect()}
    assert got == near_classes(texts(spark))
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = {}
    for g in range(6):
        base = [rng.choice(words) for _ in range(120)]
        for c in range(12):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = "edit"
            rows[g * 100 + c] = " ".join(own)
    got = {r.doc_id: r.class_id for r in minhash.classes(frame(spark, [(i, t, "a") for i, t in rows.items()])).collect()}
    assert got == near_classes(rows)
    own = sorted(((r.doc_id, r.class_id) for r in minhash.classes(odd).collect()), key=str)
    assert own == sorted([(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 5)], key=str)
    assert minhash.one_of_each(odd).count() == 6 and minhash.one_of_each(none).count() == 0
    assert minhash.one_of_each(odd).columns == odd.columns


# 3, 9


def test_quality_cases(spark, odd, none):
    got = {r.doc_id: r for r in quality.rules(odd).collect()}
    assert got[1].n_words == got[2].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[3].n_words == 150000 and got[3].n_repeat_words == 150000 and got[3].base_failed
    assert quality.rules(none).count() == 0
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, "fine") for i in range(30)] + [(100 + i, good if i % 10 == 0 else "short", "poor") for i in range(30)]
    kept = {r.doc_id for r in quality.rules(frame(spark, rows)).where("kept").collect()}
    assert kept == set(range(30))


def test_mixing_cases(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == 7 and mixing.mix(none).count() == 0 and {r.size for r in got} == {0, 9, 150000}
    assert mixing.emit(odd).columns == odd.columns and mixing.emit(none).count() == 0
    rows = [(i, "w " * (i % 40 + 1), f"s{i % 7}") for i in range(3000)]
    mixed = mixing.mix(frame(spark, rows)).toPandas()
    assert (mixed.taken <= 2 * mixed["size"]).all()
    assert mixed.groupby(mixed.doc_id % 7).target.first().sum() == pytest.approx(1.5 * mixed["size"].sum())
    by = mixed.assign(source=mixed.doc_id % 7).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken / by.target - 1) < 0.1).all()
    emitted = mixing.emit(frame(spark, rows)).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert emitted == {int(r.doc_id): int(r.taken // r["size"]) for _, r in mixed.iterrows() if r.taken}


# 4, 5


def test_store_gives_the_librarys_ids(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(store.model_path())
    at = 0
    got = {r.doc_id: r for r in queries.op4_token_store(spark, SF).collect()}
    for i, t in sorted(texts(spark).items()):
        ids = [*tk.encode(t, add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    path = str(tmp_path / "odd")
    store.write(odd, path)
    told = store.verify(spark, path)
    back = store.read(spark, path, keep=True).orderBy("start").collect()
    assert told["documents"] == 7 and told["ids"] == sum(r.n_tokens for r in back) and [r.doc_id for r in back] == [None, 1, 2, 3, 4, 4, 5]
    assert bytes(back[1].ids) == bytes(4) and all(r.ids is not None for r in back)
    store.write(none, str(tmp_path / "none"))
    assert store.read(spark, str(tmp_path / "none")).count() == 0 and store.verify(spark, str(tmp_path / "none"))["documents"] == 0


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write(spark.read.parquet(f"{SF}/documents.parquet"), path)
    bad = spark.read.parquet(f"{path}/segments")
    first = bad.where("pack is not null").agg(F.min("doc_id")).first()[0]
    other = bad.where("pack is not null").agg(F.max("doc_id")).first()[0]
    swap = {r.doc_id: r.pack for r in bad.where(F.col("doc_id").isin(first, other)).collect()}
    bad.withColumn("pack", F.when(F.col("doc_id") == first, F.lit(bytes(swap[other]))).otherwise(F.col("pack"))).write.parquet(f"{tmp_path}/bad/segments")
    with pytest.raises(Exception, match="doesn't agree"):
        store.read(spark, str(tmp_path / "bad")).collect()


def test_pretokens_are_the_librarys():
    enc, rng = store.encoder(store.model_path()), random.Random(2)
    alphabet = "abcXYZé \n\t .,'’1²3ªº½$#<|endoftext|>'s're 日😀 \x1c\x85́İßǅ   "
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(5000)]
    rows += ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x"]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(store.model_path())
    for t, ids in zip(rows, enc.encode(rows)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    library.encode_special_tokens = True
    for t, ids in zip(rows, store.encoder(store.model_path(), False).encode(rows)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_first_seen_pretokens_are_merged_alone(monkeypatch):
    """Pretokens of all bytes have the library's ids, also as they are forgotten and met again, and take less time than the library's own batch."""
    from tokenizers import Tokenizer, pre_tokenizers

    library, rng = Tokenizer.from_file(store.model_path()), random.Random(5)
    words = ["".join(chr(c) for c in (rng.randrange(0xA1, 0x250), rng.randrange(33, 127), rng.choice([9, 10, 13, 32]), k)) for k in range(0xA1, 0x250)]
    monkeypatch.setattr(store, "REMEMBERED", 50)
    enc = store.Encoder(store.model_path())
    for t, ids in zip(words * 2, enc.encode(words * 2)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(enc) <= 50 and len(enc.older) <= 50
    monkeypatch.undo()
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    new = [" " + "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(5)) + rng.choice("abcdefgh") for _ in range(30000)]
    new = list(dict.fromkeys(new))
    took = []
    for _ in range(3):
        enc, began = store.Encoder(store.model_path()), time.process_time()
        enc.encode(["".join(new)])
        between = time.process_time()
        library.encode_batch_fast(new, add_special_tokens=False)
        took.append((between - began) / (time.process_time() - between))
    assert min(took) < 0.95


def test_pieces_are_the_librarys(spark, odd, none):
    enc, rng = pieces.encoder(pieces.model_path()), random.Random(3)
    alphabet = 'abcdeorth  \n▁\x00é中日本語😀\t.,"\'<0x41>s/▁▁ 123 the ing tioń '
    for k in range(6000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        if k % 3 == 0:
            t = "".join(rng.choice(list(enc.id)) for _ in range(rng.randrange(1, 6))).replace(pieces.BLANK, " ")
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.sp.encode(t, add_bos=True, add_eos=True), t
    for t in ("a" * 100000, " " * 5000 + "x", "中" * 1000):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.sp.encode(t, add_bos=True, add_eos=True)
    got = {r.doc_id: r for r in pieces.round_trip(odd, keep=True).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 2 and got[3].decoded == LONG and pieces.round_trip(none).count() == 0
    for r in queries.op5_pieces(spark, SF).collect():
        t = texts_once(spark)[r.doc_id]
        ids = enc.sp.encode(t, add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(enc.sp.decode(ids).encode()).hexdigest()


def texts_once(spark, held={}):  # noqa: B006
    if not held:
        held.update(texts(spark))
    return held


# 6


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_are_those_of_all_pairs(spark, odd, none):
    rng = random.Random(6)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(2, 7) + str(rng.randrange(90)) for _ in range(40)) for _ in range(12)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(4):
            t = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = "z"
            own.append("".join(t))
        rows.append((i, "\n".join([*own, "short"]), "a"))
    df = frame(spark, rows)
    got = {r.doc_id: set(r.places) for r in lines.dropped(df).collect()}
    want = linked(rows)
    assert got == want and sum(map(len, want.values())) > 20
    out = {r.doc_id: r.text for r in lines.dedupe(odd).collect()}
    assert out[None].startswith("null id") and out[1] is None and out[2] == "" and out[3] == LONG and 5 not in out
    assert lines.dedupe(none).count() == 0 and lines.dedupe(odd).columns == odd.columns and lines.report(odd).count() == 7


def linked(rows, least=0.9):
    """Places that go, by comparing all pairs of normalised lines by their edit similarity alone."""
    occ = [(i, k, re.sub(r"[\W_]+", " ", x.lower()).strip()) for i, t, _ in rows for k, x in enumerate(t.split("\n"))]
    different = sorted({x for *_, x in occ})
    up = {x: x for x in different}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, x in enumerate(different):
        for y in different[:k]:
            most = int(max(len(x), len(y)) * (1 - least) + 1e-9)
            if most and abs(len(x) - len(y)) <= most and find(x) != find(y) and edits(x, y) <= most:
                up[find(x)] = find(y)
    kept, out = set(), {}
    for i, k, x in sorted(occ):
        if x and find(x) in kept:
            out.setdefault(i, set()).add(k)
        kept.add(find(x))
    return out


def test_lines_link_by_edit_similarity_alone(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    rows = []
    for i in range(25):
        own = [word() for _ in range((6, 9, 14, 20, 40)[i % 5])]
        other = list(own)
        other[rng.randrange(len(own))] = "zz"
        typed = list(" ".join(own))
        for k in rng.sample(range(len(typed)), len(typed) // 14):
            typed[k] = rng.choice("abcdefgh")
        rows += [(3 * i, " ".join(own), "a"), (3 * i + 1, " ".join(other), "a"), (3 * i + 2, "".join(typed), "a")]
    got = {r.doc_id: set(r.places) for r in lines.dropped(frame(spark, rows)).collect()}
    want = linked(rows)
    assert got == want and len(want) > 35


def test_short_and_unspaced_lines_repeat(spark):
    han = "我们今天在学校里学习数学和语文还有英语以及体育课程"
    rows = [(1, f"Home\nown one\n{han}", "a"), (2, f"home!\nown two\n{han[:-1]}程序", "a"), (3, "--\nchapter 10\nHOME", "a"), (4, "--\nchapter 11", "a")]
    assert {r.doc_id: r.dropped for r in lines.report(frame(spark, rows)).collect()} == {1: "", 2: "0,2", 3: "2", 4: ""}


def test_documents_with_own_short_lines_stay(spark):
    footer = "the same footer of five words"
    rows = [(1, footer, "a"), (2, f"a table\n{footer}\nof its own", "a"), (3, f"{footer}\n--", "a")]
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeated_lines(spark, frame(spark, rows), SF).collect()}
    assert got == {1: footer, 2: "a table\nof its own"}


def test_only_results_stay_in_the_shared_folder(spark):
    """What line and near-duplicate removal make on the way to their results is gone when they are done."""
    folder = f"{tables.shared_dir(spark).removeprefix('file:')}/curatrix"
    made = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    text = "one two three four five six seven eight nine ten"
    docs = frame(spark, [(i, f"{text} {i}\nthe same footer of five words\nown {i}", "a") for i in range(1, 9)])
    before = made()
    lines.dedupe(docs).count()
    minhash.one_of_each(docs).count()
    assert sorted(x.rsplit("-", 1)[0] for x in made() - before) == ["line-dropped", "near-kept"]


def test_simhash_votes(spark):
    words = [f"w{i}" for i in range(300)]
    hashes = [r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()]
    sizes = (1, 2, 5, 127, 128, 254, 300)
    table = spark.createDataFrame([(n, " ".join(words[:n] * 2)) for n in sizes], "line int, norm string")
    got = {r.line: r.sim % 2**64 for r in lines.simhash(table).collect()}
    assert got == {n: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes[:n]) > n) for n in sizes}


def test_blocks_of_the_same_lines_are_held_once(spark, monkeypatch):
    """Two lines with a long passage in common share many blocks, which all lead to one pair."""
    held = {}
    make = lines.C.materialize
    monkeypatch.setattr(lines.C, "materialize", lambda df, tag, *a, **k: held.setdefault(tag, make(df, tag, *a, **k)) if tag == "line-blocks" else make(df, tag, *a, **k))
    monkeypatch.setattr(lines.C, "discard", lambda *frames: None)
    rng = random.Random(26)
    word = lambda n=5: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = " ".join(word() for _ in range(20))
    texts_ = [f"{passage} {' '.join(word() for _ in range(6))}" for _ in range(2)]
    norms = spark.createDataFrame([(x,) for x in texts_], "norm string").select(F.unhex(F.md5(F.col("norm").cast("binary"))).alias("line"), F.xxhash64("norm").alias("h"), "norm", F.lit(None).cast("string").alias("apart"), F.lit(True).alias("long"))
    assert len({r.label for r in lines.groups(norms).collect()}) == 2
    n = held["line-blocks"].groupBy("key").count().count()
    assert 1 <= n <= 2 < lines.keys(norms).groupBy("key").count().where("count > 1").count()  # one in each grid of sizes at most


def test_blocks_are_made_and_dealt_out_once(spark, monkeypatch):
    """One scan of the lines and one exchange of their blocks lead to the table of those that lines share."""
    plans = {}
    make = lines.C.materialize
    monkeypatch.setattr(lines.C, "materialize", lambda df, tag, *a, **k: plans.setdefault(tag, df._jdf.queryExecution().sparkPlan().toString()) and make(df, tag, *a, **k))
    text = "one two three four five six seven eight nine ten"
    docs = frame(spark, [(i, f"{text} {i}", "a") for i in range(1, 6)])
    assert {r.doc_id: r.places for r in lines.dropped(docs).collect()} == {i: [0] for i in range(2, 6)}
    assert plans["line-held"].count("Generate explode(blocks") == 1 and plans["line-held"].count("Join") == 0


def test_long_lines_have_all_blocks(spark):
    """Copies whose edits leave one run of a long line whole are found by that run, whichever it is."""
    rng = random.Random(33)
    rows, left = [], []
    for i in range(16):
        own = " ".join("".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(80))
        other, skip = list(own), 6 * rng.randrange(2, 75)
        for k in [*range(skip - 1, 0, -14), *range(skip + 20, len(own), 14)]:
            other[k - (other[k] == " ")] = rng.choice("nopqrstuvwxyz")
        other = "".join(other)
        rows += [(2 * i, own, "a"), (2 * i + 1, other, "a")]
        left.append(sum(own[k : k + 16] == other[k : k + 16] for k in range(0, len(own) - 15, 6)))
    assert set(left) <= {1, 2} and linked(rows) == {2 * i + 1: {0} for i in range(16)}
    assert {r.doc_id: set(r.places) for r in lines.dropped(frame(spark, rows)).collect()} == linked(rows)


def test_ranges_of_sizes_lose_no_link(spark, monkeypatch):
    """Blocks dealt out in ranges of sizes lead to the groups that those of the whole table do."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told = lambda: {(r.doc_id, tuple(r.places)) for r in lines.dropped(docs).collect()}
    whole = told()
    held = []
    make = lines._held
    monkeypatch.setattr(lines, "WHOLE", 0)
    monkeypatch.setattr(lines, "_held", lambda fuzzy, width, low, high: held.append((low, high)) or make(fuzzy, width, low, high))
    assert told() == whole and len(whole) > 20 and len(held) == lines.RANGES


def test_blocks_at_far_places_make_no_pair(spark, monkeypatch):
    """Lines that share a phrase at places further apart than edits of a link can move it aren't compared; those with it in one place are."""
    pairs = []
    make = lines.C.materialize
    monkeypatch.setattr(lines.C, "materialize", lambda df, tag, *a, **k: pairs.append(df.count()) or make(df, tag, *a, **k) if tag == "line-pairs" else make(df, tag, *a, **k))
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    phrase = " ".join(word() for _ in range(5))
    own = [[word() for _ in range(40)] for _ in range(3)]
    at = lambda ws, k: " ".join([*ws[:k], phrase, *ws[k:]])
    far = [(1, at(own[0], 2), "a"), (2, at(own[1], 35), "a")]
    assert lines.dropped(frame(spark, far)).count() == 0 and pairs and not any(pairs)
    pairs.clear()
    near = [*far, (3, at(own[0], 2).replace("a", "", 3), "a"), (4, at(own[1], 35).replace("e", "xx", 4), "a")]
    assert {r.doc_id: set(r.places) for r in lines.dropped(frame(spark, near)).collect()} == linked(near) == {3: {0}, 4: {0}}
    assert pairs[0] == 2


def test_places_of_blocks_are_within_their_bounds(spark):
    """Every block of a line is found, in the slice where it begins; those of texts taken apart may be anywhere."""
    rng = random.Random(42)
    texts_ = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(n)) for n in (1, 3, 7, 12, 20, 26, 40, 90, 400)]
    rows = [(i, t, None) for i, t in enumerate(texts_)] + [(99, "我们今天", "我 们 今 天")]
    got = {(r.h, r.key, r.spot) for r in lines.keys(spark.createDataFrame(rows, "h long, norm string, apart string")).collect()}
    want = []
    for i, t, apart in rows:
        x = apart or t
        wide = max(8, -(-len(x) // lines.SLICES))
        starts = [k for k in range(len(x)) if k == 0 or x[k - 1] == " "]
        want += [(i, x[k : k + run], len(t) * 32 + (31 if apart else k // wide)) for run, least, most in lines.RUNS if least <= len(x) <= most for k in starts if k + run <= len(x)]
    keyed = spark.createDataFrame(want, "h long, block string, spot long").select("h", F.xxhash64("block").alias("key"), "spot").collect()
    assert got == {(r.h, r.key, r.spot) for r in keyed} and len(got) > 300


def test_parts_of_pairs_lose_none(spark, monkeypatch):
    """Pairs that meet their texts in parts have the edits that they have at once."""
    monkeypatch.setattr(lines, "PAIRS", 0)
    made = []
    make = lines.C.materialize
    monkeypatch.setattr(lines.C, "materialize", lambda df, tag, *a, **k: made.append(tag) or make(df, tag, *a, **k))
    norms = [f"one two three four five six seven eight {i}" for i in range(12)] + ["nothing like the others at all"]
    texts_ = spark.createDataFrame([(i, bytes([i]), x) for i, x in enumerate(norms)], "h long, line binary, norm string")
    pairs = spark.createDataFrame([(i, k) for i in range(13) for k in range(i)], "a long, b long")
    got = {(r.a, r.b): r.edits for r in lines._verified(pairs, texts_, lines.SIMILAR).collect()}
    most = lambda x, y: int(max(len(x), len(y)) * 0.1 + 1e-9)
    assert got == {(i, k): e if (e := edits(norms[i], norms[k])) <= most(norms[i], norms[k]) else None for i in range(13) for k in range(i)}
    assert made.count("line-part") == lines.PARTS and None in got.values()


def test_texts_are_dealt_out_at_any_size(spark):
    """Few documents that lose lines or stay don't change the join with the texts, so that what it deals out grows with the input."""
    docs = frame(spark, [(i, f"one two three four five six seven\nown line {i}", "a") for i in range(1, 6)])
    for out in (lines.dedupe(docs), minhash.one_of_each(docs)):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def similar_lines(texts_, least=lines.SIMILAR):
    """All pairs of different normalised lines of 5 words or 20 characters and more by edit similarity; sizes and pair counts rule most out."""
    import duckdb

    every = {re.sub(r"[\W_]+", " ", x.lower()).strip() for t in texts_ for x in t.split("\n")}
    every = sorted((x for x in every if x.count(" ") >= lines.LEAST - 1 or len(x) >= lines.CHARACTERS), key=lambda x: (len(x), x))
    size = np.array([len(x) for x in every])
    bags = np.zeros((len(every), 512), np.float32)
    for k, x in enumerate(every):
        np.add.at(bags[k], [zlib.crc32(x[i : i + 2].encode()) % 512 for i in range(len(x) - 1)], 1)
    found = []
    for k in range(len(every)):
        near = np.arange(np.searchsorted(size, size[k] * least - 1e-6), k)
        # an edit changes two pairs of characters at most
        most = int(size[k] * (1 - least) + 1e-9)
        found += [(every[j], every[k], most) for j in near[np.maximum(bags[k] - bags[near], 0).sum(1) <= 2 * most] if most]
    import pandas as pd

    pairs = pd.DataFrame(found, columns=["x", "y", "most"])
    con = duckdb.connect()
    con.register("pairs", pairs)
    return con.execute("select x, y from pairs where levenshtein(x, y) <= most").fetchall()


def test_recall_of_similar_lines_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = similar_lines([r.text for r in docs.select("text").collect() if r.text])
    label = {r.norm: r.label for r in lines.groups(lines.occurrences(docs)).join(lines.occurrences(docs).select("line", "norm").distinct(), "line").select("norm", "label").collect()}
    hit = sum(x in label and label[x] == label.get(y) for x, y in wanted)
    assert len(wanted) > 200 and hit >= 0.98 * len(wanted)


# 7


def test_segments_are_maximal():
    rng = random.Random(7)

    def best(s, a, b):
        found = None
        for i in range(a, b):
            t = 0.0
            for j in range(i, b):
                t += s[j]
                if t > 0 and (found is None or t > found[0]):
                    found = (t, i, j + 1)
        return [] if found is None else best(s, a, found[1]) + [found] + best(s, found[2], b)

    for _ in range(500):
        s = [rng.gauss(-0.3, 1) for _ in range(rng.randrange(16))]
        assert [(b, c) for _, b, c in toxicity.segments(s)] == [(b, c) for _, b, c in best(s, 0, len(s))]


def test_toxicity_held_out(spark, none):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.93 and got.score.between(0, 1).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert toxicity.toxic(none, labels).count() == 0
    scores = toxicity.toxic(frame(spark, [(1, None, "a"), (2, "", "a"), (None, "x", "a"), (2, "", "a")]), labels.limit(0)).collect()
    assert len(scores) == 4 and {r.score for r in scores} == {0.0}


# 8


def test_secrets_base_is_the_plain_search():
    rx = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rng = random.Random(8)
    for _ in range(4000):
        parts = rng.choice([["password", "token", "ſecret", "api_key", "aPikey", "=", ":", " ", '"', "'", "abc123", "x"], ["AKIA", "A", "Z9", "a", " "], [*"0123456789abcdef" * 4, "g"]])
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        want = [(m.start(), 0, m.end()) for m in rx.finditer(t) if len(m.group(2)) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
        assert [x[:3] for x in secrets.base_spans(t)] == sorted(want)


def plain_secrets(t):
    rx = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in rx.finditer(t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24])


def test_secrets_query_on_documents(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op8_secrets(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in got} == set(text) and len(got) == len(text)
    for r in got:
        want = plain_secrets(text[r.doc_id] or "")
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in want) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_automata_give_probabilities():
    model = secrets.Automaton(["ab"] * 200 + ["abb"] * 100 + ["b"] * 10)
    import itertools as it
    import math

    total = 0.0
    for n in range(4):
        total += sum(math.exp(model.score("".join(v)) * (n + 1)) for v in it.product("ab", repeat=n))
    assert 0.5 < total < 1 and model.score("ab") > model.score("ba") and model.score("ab") > model.score("abbbbbbb")
    own = model.table[0]
    seen = sum(math.exp(p) for _, p in own[0].values()) + math.exp(own[2]) + math.exp(own[1][1]) * (len(secrets._LETTERS) - len(own[0]))
    assert abs(seen - 1) < 1e-9


def test_automata_learn_formats(spark, odd, none):
    rng = random.Random(9)
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    model = secrets.Automaton([key() for _ in range(300)])
    assert len(model.seen) > 4 and model.score(key()) > model.score(hexa(20)) + 1
    word = lambda: "".join(rng.choice("etaoinsh") for _ in range(9))
    rows = [(i, f"{word()} password={hexa(18)} {word()} {key()} {word()}", "a") for i in range(200)]
    rows += [(300 + i, " ".join(word() for _ in range(40)), "a") for i in range(200)] + [(900, f"left {hexa(18)} alone", "a"), (901, "abcdefghijklm2nopqrstuvwxyz", "a")]
    got = {r.doc_id: r for r in secrets.digest(secrets.spans(frame(spark, rows))).collect()}
    assert got[0].n_assign == got[0].n_access == 1 and got[900].spans == "assign:5:23" and got[901].spans == "" and got[300].spans == ""
    assert secrets.digest(secrets.spans(odd)).count() == 7 and secrets.digest(secrets.spans(none)).count() == 0


def test_short_and_dotted_secrets_are_candidates(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("etaoinsh") for _ in range(9))
    pin = lambda: "".join(rng.choice("0123456789") for _ in range(8))
    dotted = lambda: ".".join("".join(rng.choice("XQZ789") for _ in range(4)) for _ in range(3))
    rows = [(i, f"{word()} password={pin() if i % 2 else dotted()} {word()}", "a") for i in range(300)]
    rows += [(300 + i, " ".join(word() for _ in range(20)), "a") for i in range(200)] + [(900, f"left {pin()} alone", "a"), (901, f"left {dotted()}.", "a")]
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.spans(frame(spark, rows))).collect()}
    assert got[900] == "assign:5:13" and got[901] == "assign:5:19" and got[300] == ""


def test_background_is_all_words(spark):
    rng = random.Random(11)
    ident = lambda: "X" + "".join(rng.choice("0123456789") for _ in range(17))
    # identifiers beside credentials are ordinary words too
    rows = [(i, f"password={ident()} and order {ident()} " + " ".join(ident() for _ in range(20)), "a") for i in range(300)]
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.spans(frame(spark, rows))).collect()}
    assert all("," not in x and x.startswith("assign:0:") for x in got.values())


# 10


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    frame_ = table.toPandas()
    x, ids = np.stack(frame_.embedding.values).astype(float), frame_.vec_id.to_numpy()
    got = neighbours.search(table).toPandas().groupby("query_id")
    hit = total = 0
    for q, own in got:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(own.vec_id))
        total += 20
        at = {i: k for k, i in enumerate(ids)}
        assert np.allclose([s[at[v]] for v in own.vec_id], own.score, atol=1e-12) and list(own["rank"]) == list(range(1, 21))
    assert total == 20 * (ids % 20 == 0).sum() and hit / total >= 0.9


def test_neighbours_cases(spark):
    v = lambda *x: [float(i) for i in x]
    rows = [(0, v(1, 0)), (1, v(1, 0)), (2, v(1, 0)), (3, v(0, 1)), (20, v(1, 0)), (4, None), (5, v(0, 0)), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, v(1)), (None, v(1, 1)), (3, v(0, 1)), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, x, "r") for i, x in rows], "vec_id long, embedding array<float>, rank string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 1.0), (0, 4, 3, 0.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0), (20, 4, 3, 0.0)]
    assert neighbours.search(df.limit(0)).count() == 0


# pipeline


def test_pipeline(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, SF).cache()
        if name != "sentencepiece":
            assert kept.columns == docs.columns
        if name == "minhash_dedup":
            classes = near_classes({r.doc_id: r.text for r in before.select("doc_id", "text").collect()})
            assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(classes.values()))
        if name == "mixing":
            told = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
            assert {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()} == {i: c for i, c in told.items() if c}
    assert 0 < kept.count() and kept.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_shuffles_of_the_last_table_go(spark):
    """The files that a table was dealt out by go when it is let go, though its query was the last one."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = disk.getAllFiles()
        names = [files.apply(k).getName() for k in range(files.length())]
        return {n for n in names if n.startswith("shuffle_")}

    for k in range(3):
        before = held()
        made = tables.materialize(spark.range(1000).groupBy((F.col("id") % (7 + k)).alias("x")).agg(F.sum("id").alias("y")), "test-dealt")
        new = held() - before
        assert new
        tables.let_go(made)
        until = time.time() + 10
        while held() & new and time.time() < until:
            time.sleep(0.1)
        assert not held() & new
        tables.discard(made)
