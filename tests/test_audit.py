"""Operators on hand-made rows, and the whole scan on drawn photos."""

import datetime
import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.config import AuditConfig
from gleanery.functions import boxes as bx
from gleanery.functions import names as nm
from gleanery.operators import bursts, control, edits, evaluation, findings, labels, overlay, pairs, pixels, review, shift, templates, verify
from gleanery.plans import decide
from gleanery.plans.scan import Audit, check_labels
from gleanery.sources import tables
from gleanery.sources.exif import read_exif


def png(path, raster, extra=b""):
    raster = np.clip(raster, 0, 255).astype(np.uint8)
    h, w = raster.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines = b"".join(b"\0" + r.tobytes() for r in raster)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def scene(seed, h=180, w=240):
    rng = np.random.default_rng(seed)
    v = np.tile(np.linspace(0, 120, w), (h, 1))
    for _ in range(90):
        y, x, a, b = rng.integers(0, h - 8), rng.integers(0, w - 8), rng.integers(6, 40), rng.integers(6, 40)
        v[y : y + a, x : x + b] = rng.integers(0, 255)
    return v


def exif_chunk(orientation, taken):
    entries = [(274, 3, 1, struct.pack("<HH", orientation, 0)), (271, 2, 5, 100), (34665, 4, 1, struct.pack("<I", 60))]
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3)
    for tag, kind, n, v in entries:
        tiff += struct.pack("<HHI", tag, kind, n) + (v if isinstance(v, bytes) else struct.pack("<I", v))
    tiff = tiff.ljust(60, b"\0") + struct.pack("<H", 1) + struct.pack("<HHII", 36867, 2, 20, 110)
    tiff = tiff.ljust(100, b"\0") + b"Acme\0"
    tiff = tiff.ljust(110, b"\0") + taken.encode() + b"\0"
    return struct.pack(">I", len(tiff)) + b"eXIf" + tiff + struct.pack(">I", zlib.crc32(b"eXIf" + tiff))


def test_exif_of_a_png_chunk():
    found = read_exif(b"\x89PNG\r\n\x1a\n" + exif_chunk(6, "2024:01:02 03:04:05"))
    assert found == {"orientation": 6, "camera": "Acme", "taken_us": 1704164645000000}
    assert read_exif(b"junk") == {"orientation": 1, "camera": None, "taken_us": None}
    assert read_exif(b"\x89PNG\r\n\x1a\n" + exif_chunk(1, "2024:13:02 03:04:05"))["taken_us"] is None


def test_hamming_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, (40, 4))
    rows = [(i, [int(x) for x in base[i % 40] ^ (np.int64(1) << rng.integers(0, 62, 4)) * (rng.random(4) < 0.6)]) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, hash array<long>")
    found = {(r.a, r.b): r.distance for r in pairs.hamming_join(df, None, 5, bits=256).collect()}
    pop = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b, strict=True))
    assert found == {(i, j): pop(a, b) for i, a in rows for j, b in rows if i < j and pop(a, b) <= 5}


def test_cosine_join_equals_brute_force(spark):
    v = np.random.default_rng(1).normal(size=(70, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    s = v @ v.T
    assert {(r.a, r.b) for r in pairs.cosine_join(df, None, 0.5, block=16).collect()} == {(i, j) for i in range(70) for j in range(70) if i < j and s[i, j] >= 0.5}
    near = pairs.nearest(df.where("id < 10"), df.where("id >= 10"), 3, block=16).collect()
    for q in range(10):
        assert [r.id for r in sorted(near, key=lambda r: r["rank"]) if r.q == q] == (10 + np.argsort(-s[q, 10:])[:3]).tolist()


@pytest.mark.parametrize("cells", ["many", "few", "one"])
def test_cosine_join_sends_rows_to_cells_and_broadcasts_nothing(spark, monkeypatch, cells):
    if cells == "few":
        monkeypatch.setattr(pairs, "MOST_PARTS", 3)
    v = np.random.default_rng(5).normal(size=(230, 6))
    v[100:110] = v[7]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    name = lambda i: f"p{i:03d}"
    df = spark.createDataFrame([(name(i), x.tolist()) for i, x in enumerate(v)], "id string, v array<double>")
    left, right = df.where("id < 'p190'"), df.where("id >= 'p180'")
    s, block = v @ v.T, {"many": 16, "few": 16, "one": 4096}[cells]
    near = lambda among: sorted((name(i), name(j), round(s[i, j], 9)) for i, j in among if s[i, j] >= 0.5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for other, among in ((right, ((i, j) for i in range(190) for j in range(180, 230))), (None, ((i, j) for i in range(190) for j in range(i + 1, 190))), (right.where("id = ''"), ())):
            joined = pairs.cosine_join(left, other, 0.5, block=block)
            assert sorted((r.a, r.b, round(r.similarity, 9)) for r in joined.collect()) == near(among)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan and "Join" not in plan
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_cosine_join_leaves_out_rows_without_a_vector(spark):
    df = spark.createDataFrame([(1, [0.6, 0.8]), (2, None), (3, [0.8, 0.6])], "id long, v array<double>")
    assert [tuple(r) for r in pairs.cosine_join(df, None, 0.9).select("a", "b", F.round("similarity", 9)).collect()] == [(1, 3, 0.96)]
    assert sorted((r.a, r.b) for r in pairs.cosine_join(df, df, 0.9).collect()) == [(1, 1), (1, 3), (3, 1), (3, 3)]


def test_minus_pairs_ignores_order(spark):
    p = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    assert [tuple(r) for r in pairs.minus_pairs(p, spark.createDataFrame([(2, 1)], "a long, b long")).collect()] == [(3, 4)]


def test_a_gap_of_just_three_seconds_stays_in_the_burst(spark):
    s = 1_000_000
    rows = [("c", 0, "a", False), ("c", 3 * s, "b", True), ("c", 6 * s + 1, "d", False), ("e", 0, "f", False)]
    shots = spark.createDataFrame(rows, "camera string, taken_us long, file string, is_test boolean")
    (one,) = bursts.find_bursts(shots).collect()
    assert (one.files, one.test_files, one.span) == (["a", "b"], ["b"], 3.0)
    known = spark.createDataFrame([("b", "a")], "a string, b string")
    assert bursts.find_bursts(shots, known).count() == 0


def test_yolo_lines(spark):
    text = "0 .5 .5 .2 .2\nx .5 .5 .2 .2\n\n1 0.1 0.1 0.9 0.1 0.9 0.8\n-1 .5 .5 .2 .2\n2 nan .5 .2 .2\n0 .5 .5 .2 .2 .99\r\n3 1 2"
    p = labels.parse_yolo(spark.createDataFrame([("f", text)], "file string, text string"))
    got = {r.line: (r.cls, r.malformed, r.box_no) for r in p.collect()}
    assert got == {1: (0, False, 1), 2: (None, True, None), 4: (1, False, 2), 5: (None, True, None), 6: (None, True, None), 7: (0, False, 3), 8: (None, True, None)}


def test_labels_of_three_formats(spark):
    photos = spark.createDataFrame([("up1__a.jpg", 100, 50, 1), ("b.png", 100, 50, 6), ("c.png", 40, 40, 1), ("d.jpg", 9, 9, 1), ("d.png", 9, 9, 1)], "photo string, aw int, ah int, orientation int")
    box = "<object><name>x</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>20</xmax><ymax>20</ymax></bndbox></object>"
    coco = '{"images": [{"id": 1, "file_name": "c.png", "width": 80, "height": 80}, {"id": 2, "file_name": "no.png"}], "annotations": [{"image_id": 1, "category_id": 1, "bbox": [0, 0, 200, 10]}]}'
    files = [
        ("a.txt", "0 .5 .5 .2 .2\n0 .5 .5 .2 .2\nbad", None),
        ("d.txt", "0 .5 .5 .2 .2", None),
        ("b.xml", f"<annotation><filename>b.png</filename><size><width>50</width><height>100</height></size>{box}{box}</annotation>", None),
        ("e.xml", "<!DOCTYPE x><annotation></annotation>", None),
        ("c.json", coco, None),
        ("big.txt", None, "file is too large to check"),
    ]
    found = {(r.subject, r.kind) for r in check_labels(photos, spark.createDataFrame(files, "file string, text string, error string")).collect()}
    assert found == {
        ("up1__a.jpg", "malformed"), ("up1__a.jpg", "repeated"), ("d.txt", "orphan"), ("b.png", "size"), ("b.png", "repeated"), ("e.xml", "unreadable"),
        ("c.json", "orphan"), ("c.png", "size"), ("c.png", "outside"), ("big.txt", "unreadable"), ("d.jpg", "missing"), ("d.png", "missing"),
    }


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-2, 2), min_size=4, max_size=4))
def test_clamped_boxes_are_valid_and_stay(spark, v):
    df = spark.createDataFrame([tuple(v)], "x1 double, y1 double, x2 double, y2 double").select(bx.clamped(F.struct("x1", "y1", "x2", "y2")).alias("b"))
    b = df.first().b
    assert 0 <= b.x1 <= b.x2 <= 1 and b.x2 - b.x1 >= 0.05 - 1e-12 and b.y2 - b.y1 >= 0.05 - 1e-12
    again = spark.createDataFrame([tuple(b)], "x1 double, y1 double, x2 double, y2 double").select(bx.clamped(F.struct("x1", "y1", "x2", "y2")).alias("b")).first().b
    assert np.allclose(again, b)


def test_a_verdict_disputes_but_never_clears(spark):
    reviewed = spark.createDataFrame([(1, "x", "y", "x"), (2, "z", "x", "x")], "pair_no long, a string, b string, target string")
    verdicts = spark.createDataFrame([(1, "different", "r1")], "pair_no long, verdict string, reason string")
    got = {r.file: (r.action, r.verdict, r.disputed) for r in findings.resolve_verdicts(reviewed, verdicts).collect()}
    assert got == {"x": ("quarantine", "different", True), "y": ("keep", "different", False), "z": ("keep", "unsure", False)}


def test_seven_of_eight_photos_carry_an_overlay(spark):
    rng = np.random.default_rng(0)
    mark = np.zeros((60, 80))
    mark[10:20, 10:30] = 40
    for photos, stamped, there in ((8, 7, True), (8, 6, False), (7, 7, False)):
        gx, gy = rng.normal(0, 3, (photos, 60, 80)), rng.normal(0, 3, (photos, 60, 80))
        gx[:stamped] += mark
        rows = [(0, f"p{k}", 60, 80, gx[k].ravel().tolist(), gy[k].ravel().tolist()) for k in range(photos)]
        found = overlay.find_overlays(spark.createDataFrame(rows, "shape int, id string, height int, width int, gx array<double>, gy array<double>")).collect()
        assert len(found) == there
        if there:
            assert (found[0].files, found[0].box) == ([f"p{k}" for k in range(7)], [0.125, 0.167, 0.375, 0.333])


def test_five_photos_are_enough_for_shift(spark):
    rng = np.random.default_rng(0)
    make = lambda n, at, off: spark.createDataFrame([(off + i, (rng.normal(size=6) * 0.1 + at).tolist()) for i in range(n)], "id long, v array<double>")
    config = AuditConfig(shift_permutations=200)
    assert shift.check_shift(make(15, 0, 0), make(4, 0, 100), config) == {"checked": False, "train_count": 15, "test_count": 4}
    assert shift.check_shift(make(15, 0, 0), make(5, 1, 100), config)["flagged"]


def photos_of(spark, rasters):
    rows = [(n, *v.shape, 1, np.clip(v, 0, 255).astype(np.uint8).tobytes()) for n, v in rasters.items()]
    return spark.createDataFrame(rows, "name string, height int, width int, channels int, data binary")


def test_keypoints_find_a_mirrored_copy_and_no_other(spark, monkeypatch):
    a = scene(1)
    moved = a.copy()
    moved[40:90, 60:130] = scene(5)[40:90, 60:130]
    rasters = {"a": a, "mirror": a[:, ::-1], "other": scene(2), "same": a, "moved": moved, "crop": a[20:160, 30:220], "flat": np.zeros((9, 9))}
    features = verify.feature_table(photos_of(spark, rasters)).cache()
    assert features.count() == 2 * len(rasters)
    pairs_ = spark.createDataFrame([("a", k) for k in rasters if k != "a"], "a string, b string")
    got = {r.b: r for r in verify.verified(pairs_, features).collect()}
    assert got["mirror"].inliers >= 25 and got["same"].inliers >= 25 and got["crop"].inliers >= 25 and got["other"].inliers < 25
    assert got["flat"].inliers == 0 and got["flat"].box_a is None
    assert got["moved"].fixed_camera and got["moved"].inliers < 25 and not got["same"].fixed_camera
    assert all(0 <= x <= 1 for x in got["mirror"].box_a + got["crop"].box_b) and len(got["mirror"].keypoints) == got["mirror"].inliers
    # Once there is a table, nothing is detected again.
    monkeypatch.setattr(verify, "detect", None)
    refs = spark.createDataFrame([("a", "mirror", "same"), ("a", "mirror", "other")], "a string, b string, ref string")
    seen = verify.seen_in_references(verify.verified(pairs_.where("b = 'mirror'"), features), refs, features)
    share = {r.ref: r.s for r in seen.groupBy("ref").agg(F.avg(F.col("matched").cast("double")).alias("s")).collect()}
    assert share["same"] > 0.9 > 0.5 > share["other"]


def test_reference_samples(spark):
    photos = spark.createDataFrame([(k,) for k in range(300)], "id long")
    some = spark.createDataFrame([(1, 2), (3, 4), (5, 5)], "a long, b long")
    got = [tuple(r) for r in templates.reference_sample(some, photos, 40).collect()]
    assert len(got) == len(set(got)) == 120 and all(r not in (a, b) for a, b, r in got)
    few = templates.reference_sample(some, photos.where("id < 10"), 40).groupBy("a").count().collect()
    assert {r.a: r["count"] for r in few} == {1: 8, 3: 8, 5: 9}


def test_sharp_and_blurred():
    a = scene(3)
    assert pixels.laplacian_variance(a) > 10 * pixels.laplacian_variance(verify._box_mean(a, 6))


def test_names(spark):
    row = spark.createDataFrame([("in/x__Bad name!.JPG", "text/plain")], "p string, t string")
    got = row.select(nm.display_name(F.col("p")), nm.stem(F.col("p")), nm.safe_name(F.lit("._"), F.col("t")), nm.trimmed(F.lit("\x00 a \x00"))).first()
    assert tuple(got) == ("Bad name!.JPG", "x__bad name!", "photo.txt", "a")


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("photos")
    train, test, lab = (root / n for n in ("train", "test", "labels"))
    for f in (train, test, lab):
        f.mkdir()
    for k in range(6):
        png(train / f"t{k}.PNG", scene(10 + k), exif_chunk(6 if k == 0 else 1, f"2024:01:02 03:04:0{2 * (k % 2)}") if k < 2 else b"")
    png(train / "copy.png", scene(12))
    png(train / "flat.png", np.full((60, 80), 99.0), b"\0\0\0\x13tEXtSoftware\0Midjourney" + struct.pack(">I", zlib.crc32(b"tEXtSoftware\0Midjourney")))
    (train / "junk.png").write_bytes(b"junk")
    for k in range(5):
        png(test / f"u{k}.png", scene(40 + k))
    png(test / "leak.png", scene(13))
    (lab / "t1.txt").write_text("0 .5 .5 .2 .2\n")
    return train, test, lab


def test_scan(spark, folders, tmp_path):
    train, test, lab = map(str, folders)
    audit = Audit(spark, AuditConfig(shift_permutations=100), work=str(tmp_path))
    found = audit.scan(train, test, lab)
    assert audit.failures == {}
    of = lambda key, *c: sorted(tuple(r[x] for x in c) for r in found[key].collect())
    assert of("duplicate_pairs", "a", "b") == [("train/copy.png", "train/t2.PNG")]
    assert ("train/t3.PNG", "test/leak.png") in of("leaked_pairs", "a", "b")
    assert ("train/flat.png",) in of("blurry_images", "name")
    assert of("unreadable_images", "name") == [("train/junk.png",)]
    assert of("risky_orientation_images", "name", "swaps_dimensions") == [("train/t0.PNG", True)]
    assert [set(r.files) for r in found["bursts"].collect()] == [{"train/t0.PNG", "train/t1.PNG"}]
    assert of("ai_generated_images", "name", "ai") == [("train/flat.png", "Midjourney")]
    assert found["shift"]["checked"] and found["label_problems"].where("kind = 'missing'").count() == 10


def test_equal_names_in_both_folders(spark, tmp_path):
    """Photos are named by split and file, so one true leak is one pair in all tables."""
    for split, seeds in (("train", (1, 2, 3)), ("test", (7, 2, 8))):
        (tmp_path / split).mkdir()
        for name, seed in zip("abc", seeds, strict=True):
            png(tmp_path / split / f"{name}.png", scene(seed))
    png(tmp_path / "test" / "d.png", scene(3)[:, ::-1])
    audit = Audit(spark, AuditConfig(shift_permutations=20))
    found = audit.scan(str(tmp_path / "train"), str(tmp_path / "test"))
    assert audit.failures == {}
    of = lambda key: sorted((r.a, r.b) for r in found[key].collect())
    assert of("leaked_pairs") == [("train/b.png", "test/b.png")] and of("duplicate_pairs") == []
    assert of("similar_leaks") == [("train/c.png", "test/d.png")] and of("similar_pairs") == []


def test_decisions_from_a_scan(spark, folders, tmp_path):
    """Findings to files: a review by rule, one that fails, a scan that fails, and paths by session or time."""
    train, test, _ = map(str, folders)
    root = f"file://{tmp_path}"
    report = Audit(spark, AuditConfig(shift_permutations=20), work=f"{root}/work").scan(train, test)
    out = decide.run_session(spark, lambda: report, root, session="s1")
    assert not out["agent_error"] and not out["truncated"]
    gone = {r.file for r in out["decisions"].where("action = 'quarantine'").collect()}
    assert {"train/t3.PNG", "train/t2.PNG"} <= gone and "test/leak.png" not in gone
    told = json.loads((tmp_path / "results/sessions/s1.json").read_text())
    assert {"a": "train/t3.PNG", "b": "test/leak.png"}.items() <= told["leaked_pairs"][0].items() and told["decisions"]

    class Broken(review.RuleReviewer):
        def answers(self, shown, photos):
            raise RuntimeError("cut off")

    now = datetime.datetime(2024, 1, 2, 3, 4, 5)
    failed = decide.run_session(spark, lambda: report, root, reviewer=Broken(), now=now)
    assert failed["agent_error"] and failed["decisions"] is None and failed["leaked_pairs"] is report["leaked_pairs"]
    assert (tmp_path / "results/20240102T030405Z.json").read_text() == (tmp_path / "results/latest.json").read_text()

    def broken():
        raise OSError("no photos")

    with pytest.raises(OSError):
        decide.run_session(spark, broken, root, session="s2")
    assert json.loads((tmp_path / "results/sessions/s2.json").read_text()) == {"error": "scan failed"}


def test_review_of_borderline_pairs(spark):
    rows = [(1, ["a", "b"], 26), (2, ["c", "b"], 60), (3, ["d", "e"], 24)]
    copies = spark.createDataFrame(rows, "seq long, files array<string>, matching_keypoints long")
    leaks = spark.createDataFrame([(1, ["a", "x"], 30)], "seq long, files array<string>, matching_keypoints long")
    found = findings.findings({"train_test_leak_edited_copy": leaks, "edited_copy": copies})
    got = {r.file: (r.action, r.verdict, r.disputed) for r in review.decide(found, review.RuleReviewer()).collect()}
    # The leak and the closest copy are reviewed (two at most); the rest follows the rule.
    assert got == {"a": ("quarantine", "same", False), "x": ("keep", "same", False), "d": ("keep", "unsure", False), "e": ("quarantine", "unsure", True), "b": ("quarantine", None, False)}


def test_inlier_table_is_exhaustive(spark):
    rasters = {"t1": scene(1), "t2": scene(2), "v1": scene(1)[:, ::-1], "v2": scene(4), "v3": scene(2)}
    features = verify.feature_table(photos_of(spark, rasters)).cache()
    side = lambda c: features.where(F.startswith("name", F.lit(c)) & ~F.col("turned")).select("name")
    got = {(r.a, r.b): r.inliers for r in evaluation.inlier_table(side("t"), side("v"), features, block=1).collect()}
    assert set(got) == {(a, b) for a in ("t1", "t2") for b in ("v1", "v2", "v3")}
    assert {k for k, n in got.items() if n >= 25} == {("t1", "v1"), ("t2", "v3")}


def test_edits_keep_what_they_should(spark):
    v = scene(6)[:64, :64]
    df = spark.createDataFrame([(v.ravel().tolist(),)], "v array<double>")
    made = df.select(edits.cropped(F.col("v"), 64, 64).alias("crop"), edits.recompressed(F.col("v"), 64, 64, 8.0).alias("jpeg"), edits.stamped(F.col("v"), 64, 64, True, 0.5).alias("tiled")).first()
    rows = 8 + np.arange(64) * 48 // 64
    assert (np.array(made.crop).reshape(64, 64) == v[np.ix_(rows, rows)]).all()
    jpeg = np.array(made.jpeg).reshape(64, 64)
    assert (jpeg[::2, ::2] == jpeg[1::2, 1::2]).all() and np.abs(jpeg[::2, ::2] - v.reshape(32, 2, 32, 2).mean((1, 3))).max() <= 4
    mask = np.array(edits.mark(64, 64, True)).reshape(64, 64)
    assert np.allclose(np.array(made.tiled).reshape(64, 64), np.where(mask, v / 2 + 127.5, v))
    with pytest.raises(ValueError):
        edits.perturbed(F.col("v"), "louder", 64, 64)


def test_tables_in_and_out(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "a.csv").write_text("page,n\nx,1\ny,\n")
    (tmp_path / "a.json").write_text('[{"id": 1, "s": "x"}, {"id": 2}]')
    assert [tuple(r) for r in tables.read_csv(spark, f"{root}/a.csv", "page string, n int").orderBy("page").collect()] == [("x", 1), ("y", None)]
    assert [tuple(r) for r in tables.read_json(spark, f"{root}/a.json", "id int, s string").orderBy("id").collect()] == [(1, "x"), (2, None)]
    for scan, n in (("s1", 3), ("s2", 5), ("s1", 2)):
        tables.write_report({"t": spark.range(n)}, f"{root}/report", scan)
    assert {r.scan: r["count"] for r in spark.read.parquet(f"{root}/report/t").groupBy("scan").count().collect()} == {"s1": 2, "s2": 5}
    flagged = spark.createDataFrame([("a", "b", 3), ("c", "d", 9)], "a string, b string, inliers int")
    tables.write_flagged(flagged, f"{root}/flagged")
    assert [r.inliers for r in spark.read.csv(f"{root}/flagged", header=True).collect()] == ["9", "3"]
    tables.write_json(flagged, f"{root}/json")
    assert spark.read.json(f"{root}/json").count() == 2


def test_log_and_forget(spark):
    log = spark.createDataFrame([("d1", "a" * 32)], "day string, session string")
    asked = spark.createDataFrame([("d1", "a" * 32), ("d2", "a" * 32), ("d2", "a" * 32), ("d2", "bad")], "day string, session string")
    assert [tuple(r) for r in control.new_log_entries(log, asked).collect()] == [("d2", "a" * 32)]
    objects = spark.createDataFrame([("saved/o/s/images/0/x.jpg",), ("saved/o/s2/images/0/x.jpg",)], "key string")
    assert [r.key for r in control.forgotten(objects, "o", "s").collect()] == ["saved/o/s/images/0/x.jpg"]


def test_one_hash_that_many_photos_have(spark):
    """Its photos meet in an equi-join; the band sees the hash once."""
    rows = [(i, [7, 0, 0, 0]) for i in range(50)] + [(50, [6, 0, 0, 0]), (51, [-1, -1, 0, 0])]
    found = pairs.hamming_join(spark.createDataFrame(rows, "id long, hash array<long>"), None, 5, bits=256).collect()
    assert {(r.a, r.b, r.distance) for r in found} == {(i, j, 0) for j in range(50) for i in range(j)} | {(i, 50, 1) for i in range(50)}


def test_no_leak_keys_without_a_test_folder(spark, folders):
    found = Audit(spark).scan(str(folders[2]))
    assert not {"leaked_pairs", "similar_leaks", "shift", "label_problems"} & set(found)


def test_streaming_twin_of_bursts(spark, tmp_path):
    from gleanery.streaming.sessions import burst_sessions, scan_new_files

    rows = [("c", 0), ("c", 3), ("c", 7), ("d", 1), ("c", 500)]
    spark.createDataFrame(rows, "camera string, s int").select("camera", F.timestamp_seconds("s").alias("taken")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("camera string, taken timestamp").parquet(str(tmp_path / "in"))
    query = burst_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.camera, r.n, r.span_us) for r in spark.table("sessions").collect()] == [("c", 2, 3_000_000)]
    (tmp_path / "pics").mkdir()
    png(tmp_path / "pics/a.png", scene(1))
    seen = []
    for _ in range(2):
        scan_new_files(spark, str(tmp_path / "pics"), str(tmp_path / "cp2"), lambda df, _: seen.extend(r.length for r in df.collect()))
    assert len(seen) == 1
