import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import containers
from curatrix.functions import expr as X
from curatrix.operators import analytics, catalog, confirm, families, graph, primary, review, similar


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_hash_distances(spark):
    rows = [("VKWKGsBWNqw=", "VI0rGsRmdTw=", 13), ("MqKImVbGMos=", "MqLYiT7XK6o=", 13), ("FMua5pgrqTs=", "FMua5rgrqTs=", 1), ("FMua5pgrqTs=", "NMua5rgrqTs=", 2)]
    df = spark.createDataFrame(rows, "a string, b string, d int")
    assert df.where(X.hamming(X.phash_value(F.col("a")), X.phash_value(F.col("b"))) != F.col("d")).count() == 0
    bad = spark.createDataFrame([("",), ("!!!",), ("AAAA",), ("AAAAAAAAAAAAAAAAAAAA",), (None,)], "p string")
    assert bad.where(X.phash_value(F.col("p")).isNotNull()).count() == 0


KEYS = [
    ("img_5794", ["subject:img_5794"], False),
    ("defaultimg_5794-2", ["subject:img_5794"], True),
    ("defaultimg_5808_cr2_embedded", ["subject:img_5808"], True),
    ("1-defaultimg_1823_cr2_shotwell", ["subject:img_1823"], True),
    ("img_20171215_134834_0162", ["subject:img_0162", "subject:img_20171215_134834_0162", "timestamp:20171215-134834"], False),
    ("20191219-215605-3", ["subject:20191219-215605-3", "timestamp:20191219-215605"], True),
    ("20240330-185345997", ["subject:20240330-185345997", "timestamp:20240330-185345"], False),
]


def test_family_keys(spark):
    df = spark.createDataFrame([(f"a/b.c/{s}.JPG",) for s, _, _ in KEYS] + [("a/noext",), ("a/.hidden",)], "p string")
    got = df.select(X.family_keys(F.col("p")).alias("k"), X.is_derived(F.col("p")).alias("d")).collect()
    assert [(r.k, r.d) for r in got[:-2]] == [(k, d) for _, k, d in KEYS] and got[-2].k is None and got[-1].k is None


def test_times(spark):
    r = one(spark, q=X.rfc3339(X.quicktime_time(F.lit(3818631896))), n=X.quicktime_time(F.lit(0)), l=X.rfc3339(X.loose_time(F.lit("2024-09-10T11:12:13+08:00"))), z=X.loose_time(F.lit("nothing")), ns=X.nanos_rfc3339(F.lit(1700000000123456789)), f=X.filename_date(F.lit("x_20240230_y")), g=X.rfc3339(X.filename_date(F.lit("IMG_2024-02-29.jpg"))))
    assert (r.q, r.n, r.l, r.z) == ("2025-01-02T03:04:56+00:00", None, "2024-09-10T03:12:13+00:00", None)
    assert r.ns == "2023-11-14T22:13:20.123456789+00:00" and r.f is None and r.g == "2024-02-29T00:00:00+00:00"


def box(kind, payload):
    return struct.pack(">I4s", 8 + len(payload), kind) + payload


def test_containers():
    mvhd = box(b"mvhd", struct.pack(">II", 0, 3818631896) + bytes(12))
    assert containers.container_time("video/mp4", box(b"ftyp", b"isom") + box(b"moov", mvhd)).isoformat() == "2025-01-02T03:04:56+00:00"
    key = b"com.apple.quicktime.creationdate"
    keys = box(b"keys", struct.pack(">II", 0, 1) + box(b"mdta", key))
    item = box(struct.pack(">I", 1), box(b"data", bytes(8) + b"2024-09-10T11:12:13+08:00"))
    told = box(b"moov", mvhd + box(b"meta", keys + box(b"ilst", item)))
    assert containers.container_time("video/quicktime", told).isoformat() == "2024-09-10T03:12:13+00:00"
    nanos = struct.pack(">q", 734_000_000 * 10**9)
    info = b"\x15\x49\xa9\x66" + bytes([0x80 | 11]) + b"\x44\x61\x88" + nanos
    mkv = b"\x1aE\xdf\xa3\x80" + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + info
    assert containers.container_time("video/webm", mkv) == containers.EPOCH_2001 + containers.timedelta(seconds=734_000_000)
    for cut in range(len(told)):
        containers.isobmff_time(told[:cut])
    for cut in range(len(mkv)):
        containers.matroska_time(mkv[:cut])


def test_primary_rules(spark):
    rows = [
        (53817, "repo/2024/03/30/DSC00977.ARW", 37888000, 7028, 4688, "image/x-sony-sr2"), (53772, "repo/2024/03/30/20240330-185345997.arw", 37888000, 7028, 4688, "image/x-sony-sr2"),
        (40917, "repo/2024/03/30/DSC00977.JPG", 13010199, 7008, 4672, "image/jpeg"), (40603, "repo/2024/03/30/20240330-185345997.jpg", 222323, 1616, 1080, "image/jpeg"),
        (36754, "repo/2025/03/17/defaultdsc00977.arw", 27250, 600, 400, "image/jpeg"), (36740, "repo/2025/03/17/defaultdsc00977.jpg", 27142, 598, 400, "image/jpeg"),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "group_id long, id long, target_path string, size_bytes long, width long, height long, mime_type string")
    assert primary.catalog_primary(df).first().primary_id == 53817 and primary.review_primary(df).first().primary_id == 53772
    cyclic = [(1, i, f"p{i}", i, a, 1, "image/png") for i, a in ((1, 10000), (2, 9900), (3, 9750))]
    for _ in range(3):
        random.shuffle(cyclic)
        assert primary.catalog_primary(spark.createDataFrame(cyclic, df.schema)).first().primary_id == 2


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, 999) for k in range(400, 460)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bridges_split_a_component(spark):
    # three groups joined by two bridges are one component, and three without them
    inner = [(a, b) for g in (range(6), range(10, 12), range(20, 24)) for a, b in zip(g, list(g)[1:])]
    both = inner + [(11, 5), (10, 20)]
    count = lambda e: graph.connected_components(spark.createDataFrame(e, "a long, b long")).select("component").distinct().count()
    assert count(both) == 1 and count(inner) == 3


def test_indexed_pairs_are_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    rows = [(i, (h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(12)))) - 2**63) for i, h in enumerate(base * 3)]
    df = spark.createDataFrame(rows, "id long, h long")
    whole, index = (sorted(map(tuple, similar.hamming_pairs(df, 14, m).collect())) for m in ("whole", "index"))
    assert whole == index and len(whole) > 50


def test_hashes_meet_in_blocks(spark):
    """Widths, equal, unknown and empty contents and repeated ids give the same pairs either way, and hashes aren't dealt out under their variants."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    rows = [(i // 2 if i % 9 == 0 else i, (base[i % 20] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))) - 2**63 if i % 3 else base[i % 20] - 2**63, rng.choice([None, "", "x", "y"]), rng.choice([64, 256, 0])) for i in range(160)]
    df = spark.createDataFrame([*rows, (1000, None, "x", 64)], "id long, h long, exact_hash string, phash_bits int")
    sc = spark.sparkContext
    sc.setJobGroup("blocks", "")
    whole, index = (sorted(map(tuple, similar.hamming_pairs(df, 14, m).collect())) for m in ("whole", "index"))
    assert whole == index and len(whole) > 100
    sc.setJobGroup("dealt", "")
    similar.hamming_pairs(df.select("id", "h"), 14, "index").collect()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("dealt") for s in tracker.getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    written = [store.lastStageAttempt(s).shuffleWriteRecords() for s in stages]
    assert 0 < sum(written) < 160 * 100


def test_family_links_have_the_edges_components(spark):
    rng = random.Random(8)
    rows = [(i, f"r/{rng.choice(['img_%d', 'defaultimg_%d-2', '1-defaultimg_%d_cr2'])}.jpg" % rng.randrange(25), rng.choice([100, 200]), 150, rng.choice([None, "a", "b"])) for i in range(120)]
    found = families.candidates(spark.createDataFrame(rows, "id long, target_path string, width long, height long, optics string"))
    a = {tuple(r) for r in graph.connected_components(families.edges(found)).collect()}
    assert a == {tuple(r) for r in families.components(found).collect()}


def test_lens_and_orientation_split_a_family(spark):
    rows = [(1, "a/img_2454.jpg", 600, 400, "18-135"), (2, "b/IMG_2454.JPG", 400, 600, "50"), (3, "c/defaultimg_2454-2.jpg", 400, 600, None)]
    found = families.candidates(spark.createDataFrame(rows, "id long, target_path string, width long, height long, optics string"))
    assert {tuple(r) for r in families.edges(found).collect()} == {(2, 3)}


def test_paging():
    assert review.paging() == (0, 20) and review.paging(page=3, page_size=5000) == (2, 1000) and review.paging(page_index=0, limit=0) == (0, 1)
    assert review.page_info(0, 3, 20) == {"total": 0, "pages": 0, "current_page": 1} and review.page_info(41, 9, 20)["current_page"] == 3


def test_rejecting_moves_to_the_groups_trash(spark):
    rows = [(1, "repo/2024/06/09/keep-a.png", 42, "undecided"), (2, "repo/2024/06/09/reject-a.png", 42, "undecided"), (3, "repo/2024/06/09/keep-b.png", 43, "kept")]
    members = spark.createDataFrame([(*r, False) for r in rows], "id long, target_path string, group_id long, keep_state string, is_group_primary boolean")
    said = spark.createDataFrame([(42, ["repo/2024/06/09/keep-a.png"], ["repo/2024/06/09/reject-a.png"])], "group_id long, kept array<string>, rejected array<string>")
    got = {r.id: (r.target_path, r.keep_state) for r in review.decided(members, said, "repo").collect()}
    assert got[2] == (f"repo{X.TRASH}group-42/reject-a.png", "rejected") and got[1][1] == "kept" and got[3] == ("repo/2024/06/09/keep-b.png", "kept")


def test_snapshots_and_stream(spark, tmp_path):
    from curatrix.streaming.incremental import ingest

    schema = "target_path string, size_bytes long, mime_type string, exact_hash string, width long, height long, created_at string, meta_json string"
    source, root = str(tmp_path / "in"), str(tmp_path / "catalog")
    spark.createDataFrame([("r/a", 1, "", "x", 1, 1, "2024", "{}"), ("r/b", 2, "", "y", 1, 1, "2024", "{}")], schema).write.parquet(source)
    ingest(spark, source, schema, root)
    spark.createDataFrame([("r/b", 3, "", "z", 1, 1, "", "{}"), ("r/0", 4, "", "w", 1, 1, "2024", "{}")], schema).write.mode("append").parquet(source)
    ingest(spark, source, schema, root)
    got = {r.target_path: (r.id, r.size_bytes, r.created_at) for r in catalog.Snapshots(spark, root).read("items").collect()}
    assert got == {"r/a": (1, 1, "2024"), "r/b": (2, 3, "2024"), "r/0": (3, 4, "2024")}
    assert catalog.Snapshots(spark, root).read("log").count() == 2


def test_discovery(spark, tmp_path):
    from curatrix.sources import discover

    for name, data in (("a.jpg", b"\xff\xd8\xffx"), ("sub/b.mkv", b"xyz"), (".hid/c.jpg", b"1"), ("trash/d.jpg", b"2"), ("_e.bin", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.relative: (r.mime_type, r.size_bytes) for r in discover.facts(discover.list_files(spark, [str(tmp_path)], 2)).collect()}
    assert got == {"a.jpg": ("image/jpeg", 4), "sub/b.mkv": ("video/x-matroska", 3), "_e.bin": ("application/x-empty", 0)}


def test_blobs():
    rng = np.random.default_rng(1)
    desc = [rng.bytes(64) for _ in range(26)]
    assert len(confirm.pack_descriptors(desc)) == 1772 and confirm.unpack_descriptors(confirm.pack_descriptors(desc)) == desc
    points = rng.random((129, 2), np.float32)
    assert (confirm.unpack_points(confirm.pack_points(points)) == points).all()
    for bad in (confirm.pack_descriptors(desc)[:-1], confirm.pack_descriptors(desc) + b"x"):
        with pytest.raises(ValueError):
            confirm.unpack_descriptors(bad)


def test_confirmation():
    rng = np.random.default_rng(2)
    desc, points = [rng.bytes(64) for _ in range(40)], (rng.random((40, 2)) * 500).astype(np.float32)
    turned = points @ np.array([[0.9, 0.2], [-0.2, 0.9]], np.float32) + np.float32(15)
    a = (confirm.pack_descriptors(desc), confirm.pack_points(points))
    assert confirm.confirmed(a, (confirm.pack_descriptors(desc), confirm.pack_points(turned)))
    assert not confirm.confirmed(a, (confirm.pack_descriptors(desc), confirm.pack_points((rng.random((40, 2)) * 500).astype(np.float32))))
    assert not confirm.confirmed(a, (confirm.pack_descriptors([rng.bytes(64) for _ in range(40)]), a[1]))
    assert not confirm.confirmed((confirm.pack_descriptors(desc[:24]), confirm.pack_points(points[:24])), a)


def test_cache_priority(spark):
    schema = "exact_hash string, size_bytes long, status string, feature_version int"
    into = spark.createDataFrame([("a", 1, "ready", 7), ("b", 1, "decode_error", 7)], schema)
    source = spark.createDataFrame([("a", 1, "decode_error", 7), ("b", 1, "ready", 7), ("c", 1, "ready", 6)], schema)
    assert {r.exact_hash: r.status for r in catalog.cache_merged(into, source).collect()} == {"a": "ready", "b": "ready"}


def test_region_refresh(spark):
    rows = [(i, f"r/img_{i // 2}.jpg", 10, 10) for i in range(10)]
    schema = "id long, target_path string, width long, height long"
    before = families.components(families.candidates(spark.createDataFrame(rows, schema)))
    moved = [(i, "r/img_3.jpg" if i == 0 else p, w, h) for i, p, w, h in rows]
    found = families.candidates(spark.createDataFrame(moved, schema))
    got = {r.id: r.component for r in families.refreshed(found, before, spark.createDataFrame([(0,)], "id long")).collect()}
    want = {r.id: r.component for r in families.components(found).collect()}
    assert {k: v for k, v in got.items() if k != 1} == want


def test_group_report(spark):
    df = spark.createDataFrame([(1, 7, "h", "image/png", 1, 2, 3), (2, 7, "h", "image/png", 4, 5, 6), (3, None, "i", "", 1, 1, 1)], "id long, group_id long, exact_hash string, mime_type string, width long, height long, size_bytes long")
    assert tuple(analytics.group_summary(df).first()) == (7, 2, 1, 1, 1, 4, 2, 5, 3, 6)


def test_simhash_of_very_many_tokens(spark):
    import hashlib

    from curatrix.operators import similar

    tokens = [f"t{i}" for i in range(150_000)]
    got = similar.simhash(spark.createDataFrame([(1, " ".join(tokens)), (2, None), (3, "a a b")], "doc_id long, text string")).collect()
    hashes = [int(hashlib.md5(t.encode()).hexdigest()[:16], 16) for t in tokens]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert {r.id: r.h % 2**64 for r in got}[1] == want and len(got) == 3


def test_times_in_whole_numbers(spark):
    from curatrix.functions import containers
    from curatrix.functions import expr as X

    rows = [1699999999999999999, -1, 0, 1700000000123000000]
    got = [r.x for r in spark.createDataFrame([(n,) for n in rows], "n long").select(X.nanos_rfc3339(F.col("n")).alias("x")).collect()]
    assert got == ["2023-11-14T22:13:19.999999999+00:00", "1969-12-31T23:59:59.999999999+00:00", "1970-01-01T00:00:00+00:00", "2023-11-14T22:13:20.123+00:00"]
    forms = {
        "2024-01-02 03:04:05.678901234": "2024-01-02T03:04:05.678901+00:00", "2024-01-02T03:04:05.5": "2024-01-02T03:04:05.500+00:00",
        "2024-01-02T03:04:05.25+02:00": "2024-01-02T01:04:05.250+00:00", "2024-01-02T03:04:05Z": "2024-01-02T03:04:05+00:00", "2024:01:02 03:04:05": "2024-01-02T03:04:05+00:00",
        "2024-01-02": "2024-01-02T00:00:00+00:00", "2024/01/02 03:04:05": None, "20240102T030405": None, "": None, "\0 2024-01-02 03:04:05\0": "2024-01-02T03:04:05+00:00",
    }
    got = spark.createDataFrame([(t,) for t in forms], "t string").select("t", X.rfc3339(X.loose_time(F.col("t"))).alias("x")).collect()
    assert {r.t: r.x for r in got} == forms
    assert {t: (x := containers.loose_time(t)) and x.strftime("%Y-%m-%dT%H:%M:%S") for t in forms} == {t: x and x[:19] for t, x in forms.items()}
    micros = spark.createDataFrame([(715593600123456789,)], "n long").select(X.rfc3339(X.matroska_time(F.col("n"))).alias("x")).first().x
    assert micros.endswith(".123456+00:00")


def test_refingerprinted_keeps_other_keys(spark):
    import json

    from curatrix.operators import catalog

    meta = ['{"camera":"x","n":[1,{"a":null}],"fingerprint":{"size_bytes":1,"other":2}}', "no json", "{}", None, '{"fingerprint":{"modified_at":"t0"}}', '{"camera":"y"}', "[1]"]
    items = spark.createDataFrame([(i, f"p{i}", 7, m) for i, m in enumerate(meta)], "id long, target_path string, size_bytes long, meta_json string")
    listing = spark.createDataFrame([(f"p{i}", "t1", 7 if i != 5 else 8) for i in range(7)], "target_path string, modified_at string, size_bytes long")
    got = {r.id: json.loads(r.meta_json) for r in catalog.refingerprinted(items, listing).collect()}
    plain = {"fingerprint": {"size_bytes": 7, "modified_at": "t1"}}
    assert got == {0: {"camera": "x", "n": [1, {"a": None}], "fingerprint": {"other": 2, "size_bytes": 7, "modified_at": "t1"}}, 1: plain, 2: plain, 3: plain, 6: plain}


def test_name_review_leaves_out_grouped_rows(spark):
    from curatrix.operators import families

    rows = [(1, "repo/IMG_1.JPG", None), (2, "repo/defaultimg_1-2.jpg", 5), (3, "repo/.catalog/trash/group-1/IMG_1.JPG", None), (4, "repo/.catalog/trash/filename-group-9/IMG_1.JPG", None)]
    df = spark.createDataFrame([(i, p, g, 4, 3) for i, p, g in rows], "id long, target_path string, group_id long, width int, height int")
    assert sorted(r.id for r in families.candidates(df).collect()) == [1, 4]


def _named(spark, rows, taken, style="suffix"):
    from curatrix.operators import naming

    df = spark.createDataFrame([(i, f, n) for i, (f, n) in enumerate(rows)], "id long, folder string, name string")
    held = spark.createDataFrame(taken, "folder string, name string") if taken else None
    return [r.free for r in naming.freed(df, held, ["id"], style).orderBy("id").collect()]


def test_names_that_meet_are_numbered(spark):
    assert _named(spark, [("d", "a.jpg"), ("d", "a.jpg"), ("d", "a-1.jpg"), ("e", "a.jpg")], None) == ["a.jpg", "a-2.jpg", "a-1.jpg", "a.jpg"]
    taken = [("d", "a.jpg"), ("d", "a-2.jpg"), ("d", "a-2.jpg"), ("d", "a-04.jpg")]
    assert _named(spark, [("d", "a.jpg")] * 4, taken) == ["a-1.jpg", "a-3.jpg", "a-4.jpg", "a-5.jpg"]
    assert _named(spark, [("d", ".x"), ("d", ".x"), ("d", "n"), ("d", "n"), ("d", "b.c.d"), ("d", "b.c.d"), ("d", "b.c-1.d")], None) == [".x", ".x-1", "n", "n-1", "b.c.d", "b.c-2.d", "b.c-1.d"]
    assert _named(spark, [("d", "a"), ("d", "a"), ("d", "1-a"), ("d", "1-a")], [("d", "3-a"), ("d", "1-1-a")], "prefix") == ["a", "2-a", "1-a", "2-1-a"]


def test_free_names_are_free_on_random_names(spark):
    import random

    rnd = random.Random(5)
    for style in ("suffix", "prefix"):
        rows = [(rnd.choice("de"), rnd.choice(["a.b", "a", "a-1.b", "a-2.b", "1-a", "2-a", "a-1", "a-1-1.b", "1-1-a"])) for _ in range(60)]
        taken = [(rnd.choice("de"), rnd.choice(["a.b", "a", "a-3.b", "a-5.b", "a-12.b", "3-a", "4-a"])) for _ in range(10)]
        out = [(f, x) for (f, _), x in zip(rows, _named(spark, rows, taken, style))]
        assert len(set(out)) == len(out) and not set(out) & set(taken)
        firsts = {r for r in rows if r not in set(taken)}
        assert firsts <= set(out)


def test_decisions_set_states_primaries_and_paths(spark):
    rows = [(1, "r/a", 7, "undecided", True), (2, "r/b", 7, "kept", False), (3, "r/c", 7, "kept", False), (4, "r/x/b", 7, "undecided", False), (5, "r/a5", 8, "kept", True), (6, "r/a6", 9, "kept", False)]
    members = spark.createDataFrame(rows, "id long, target_path string, group_id long, keep_state string, is_group_primary boolean")
    said = [(7, ["r/a", "r/c"], ["r/b", "r/x/b"], "r/c"), (8, ["r/a5"], [], "r/a5"), (9, [], ["r/a6"], "r/a6"), (10, ["r/q"], [], None)]
    d = spark.createDataFrame(said, "group_id long, kept array<string>, rejected array<string>, primary string")
    assert {r.group_id: (r.outcome, r.n_changed) for r in review.resolved(members, d).collect()} == {7: ("applied", 4), 8: ("skipped", 0), 9: ("failed", 0), 10: ("failed", 0)}
    got = {r.id: (r.target_path, r.keep_state, r.is_group_primary) for r in review.decided(members, d, "r").collect()}
    t = f"r{X.TRASH}group-7/"
    assert got == {1: ("r/a", "kept", False), 2: (t + "b", "rejected", False), 3: ("r/c", "kept", True), 4: (t + "1-b", "rejected", False), 5: ("r/a5", "kept", True), 6: ("r/a6", "kept", False)}


def test_categories_of_derived_names(spark):
    from curatrix.operators import analytics

    # Published sample pairs and their categories.
    want = {
        ("img_5793.cr2", "defaultimg_5793-2.cr2"): "default_camera:same_core", ("dpp_0195.jpg", "defaultdpp_0195-2.jpg"): "default_other:same_core",
        ("img_20200305_144300.jpg", "20200305-144300-2.jpg"): "timestamp_rendition:same_id", ("20240827-185647747.jpg", "20240827-185647-2.jpg"): "timestamp_rendition:same_core",
        ("img_5526.cr2", "20130828-180646-2.jpg"): "timestamp_rendition", ("img_5808.cr2", "defaultimg_5808_cr2_embedded.jpg"): "default_embedded:same_core",
        ("img_1823.cr2", "1-defaultimg_1823_cr2_shotwell.jpg"): "default_shotwell:same_core", ("20240330-190001441.arw", "defaultdsc00984.jpg"): "default_camera:other",
        ("2013-01-12 13.22.49.jpg", "default2013-01-12_13.22.49.jpg"): "default_timestamp:same_core", ("dsc00758.arw", "defaultdsc00759.arw"): "default_camera:adjacent_id",
        ("img_5712.jpg", "defaultnwub8621.jpeg"): "default_other:other", ("img_2015_cr2_shotwell.jpg", "defaultimg_2014_cr2_embedded.jpg"): "default_embedded:adjacent_id",
        ("img_20180512_205810_0496.jpg", "defaultimg_0496-3.jpg"): "default_camera:same_id", ("img_5568_cr2_embedded.jpg", "defaultimg_5568_dng_shotwell_2_1.jpg"): "default_shotwell:same_id",
        ("2013-02-15 15.08.53.jpg", "default2013-02-15_15.09.18.jpg"): "default_timestamp", ("img_0595.jpg", "defaultf2616d111110c1aa212ce1f0b57e5996.jpg"): "default_hash:other",
    }
    rows = []
    for g, (p, o) in enumerate(want):
        rows += [(2 * g, g, f"r/{p}", True, 1000, 4000, 3000), (2 * g + 1, g, f"r/{o}", False, 10, 400, 300)]
    rows += [(100, 50, "r/defaultimg_1.jpg", False, 10, 400, 300), (101, 50, "r/img_1.jpg", True, 1000, 4000, 3000), (102, 50, "r/img_2.jpg", True, 1000, 4000, 3000)]
    df = spark.createDataFrame(rows, "id long, group_id long, target_path string, is_group_primary boolean, size_bytes long, width int, height int")
    got = {r.group_id: r.category for r in analytics.derived_pairs(df).collect()}
    assert got == dict(enumerate(want.values()))


def test_trash_variants_keep_natural_numbers(spark):
    t = f"r{X.TRASH}group-1/"
    members = spark.createDataFrame([(1, "r/1-a b.jpg", 1), (2, "r/c.jpg", 1), (3, "r/here.jpg", 1)], "id long, target_path string, group_id long")
    listing = spark.createDataFrame([(t + "1-a_b.jpg",), (t + "2-c.jpg",), (t + "1-c.jpg",), ("r/here.jpg",)], "target_path string")
    assert {r.id: r.trash_path for r in review.trash_variants(members, listing, "r").collect()} == {1: t + "1-a_b.jpg", 2: t + "1-c.jpg"}
