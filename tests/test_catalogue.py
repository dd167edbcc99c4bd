"""Parsers, registry, sources, sinks and views that SQL does not reach."""

import io
import json

import numpy as np
import pytest

from cinegrid import model, sinks
from cinegrid.functions import scalars as S
from cinegrid.operators import profile as P
from cinegrid.operators import relational as R
from cinegrid.operators import textquery as Q
from cinegrid.operators import vectors as V
from cinegrid.plans import search as plan
from cinegrid.sources import catalogue as src
from cinegrid.streaming import incremental as inc


# -- the query language

@pytest.mark.parametrize("query, want", [
    ("cat dog", [("and", "cat"), ("and", "dog")]),
    ("!rain 'Blue Sky'", [("exact", "blue sky"), ("not", "rain")]),
    ("cat|DOG bird", [("or", "cat", "dog"), ("and", "bird")]),
    ("!'blue sky'", [("exact", "blue sky")]),
    ("!a|b", [("not", "a|b")]),
    ("a|!b", [("or", "a", "!b")]),
    ("don't", [("and", "don't")]),
    ("foo'bar'baz", [("exact", "bar"), ("and", "foobaz")]),
    ("''", [("and", "''")]),
    ("| ! ||", []),
    ("  ", []),
])
def test_tokens(query, want):
    assert [(t.kind, *t.words) for t in Q.tokens(query)] == want


def test_search(spark):
    rows = [(1, "A big BLUE cat"), (2, None), (3, "a red cat"), (4, ""), (5, "100% d'accord"), (6, "catalogue")]
    df = spark.createDataFrame(rows, "ordinal long, caption string")
    ask = lambda q, n=None: [r.ordinal for r in Q.search(df, q, n).orderBy("ordinal").collect()]
    assert ask("cat") == [1, 3, 6] and ask("cat !blue") == [3, 6] and ask("'blue cat'") == [1] and ask("dog|red") == [3]
    assert ask("%") == [5] and ask("!cat") == [2, 4, 5] and ask("!") == [1, 2, 3, 4, 5, 6] and ask("", 2) == [1, 2] and ask("cat", 2) == [1, 3]


# -- ranges, order, pages

def table(spark):
    rows = [(1, "b", 3.0), (2, "a", None), (3, "c", float("nan")), (4, "a", 1.0), (5, "d", 3.0)]
    return spark.createDataFrame(rows, "ordinal long, video_name string, x double")


def test_ranges(spark):
    df = table(spark)
    ask = lambda r: [x.ordinal for x in df.where(R.in_ranges(r, df.columns)).orderBy("ordinal").collect()]
    assert ask({"x": (1, 3)}) == [1, 4, 5] and ask({"x": (2, None)}) == [1, 5] and ask({"x": (None, None)}) == [1, 2, 3, 4, 5] and ask({"y": (0, 1)}) == [] and ask({}) == [1, 2, 3, 4, 5]
    assert R.parse_ranges({"min_x": "1", "max_x": "", "min_y": None, "q": "z"}) == {"x": (1.0, None)}
    with pytest.raises(ValueError):
        R.parse_ranges({"min_x": "junk"})


def test_order_is_stable_and_pages_join_up(spark):
    df = table(spark)
    ask = lambda *a, **k: [r.ordinal for r in df.orderBy(*R.sorted_by(df, *a, **k)).collect()]
    assert ask("x") == [1, 5, 4, 2, 3] and ask("x", "asc") == [4, 1, 5, 2, 3]
    assert ask("name", "asc") == [2, 4, 1, 3, 5] and ask("name") == [5, 3, 1, 2, 4] and ask("") == [1, 2, 3, 4, 5] == ask("nothing")
    assert ask("random", seed=3) == ask("random", "asc", seed=3) and sorted(ask("random", seed=4)) == [1, 2, 3, 4, 5]
    order = R.sorted_by(df, "x")
    assert sum(([r.ordinal for r in R.page(df, order, p, 2).collect()] for p in (1, 2, 3, 4)), []) == ask("x")
    for bad in ((0, 5), (1, 0)):
        with pytest.raises(ValueError):
            R.page(df, order, *bad)


def test_ternary(spark):
    df = table(spark)
    some = spark.createDataFrame([("a",), ("a",), (None,)], "video_name string")
    only, none = R.ternary(df, some, "only", "video_name"), R.ternary(df, some, "none", "video_name")
    assert only.count() == 2 and none.count() == 3 and R.ternary(df, some, "any", "video_name").count() == 5
    with pytest.raises(ValueError):
        R.ternary(df, some, "all", "video_name")


def test_positions_chunks_sample(spark):
    df = spark.range(1000).selectExpr("id % 7 as k", "id")
    got = [(r.k, r.id) for r in R.positions(df, ["k", "id"]).orderBy("position").collect()]
    assert got == sorted(got)
    assert {r["batch"]: r["count"] for r in R.chunked(df, ["id"], 300).groupBy("batch").count().collect()} == {0: 300, 1: 300, 2: 300, 3: 100}
    a = {r.id for r in R.sample(df, 10, 1, "id", "id").collect()}
    assert len(a) == 10 and a == {r.id for r in R.sample(df.repartition(9), 10, 1, "id", "id").collect()}


def test_merge_and_upsert(spark):
    old = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 5.0)], "video_name string, x double, y double")
    new = spark.createDataFrame([("a", None, 7.0), ("c", 3.0, 8.0)], "video_name string, x double, z double")
    got = {r[0]: tuple(r)[1:] for r in R.merged(old, new, "video_name").select("video_name", "x", "y", "z").collect()}
    assert got == {"a": (1.0, None, 7.0), "b": (2.0, 5.0, None), "c": (3.0, None, 8.0)}
    up = R.upserted(old, old.where("video_name = 'a'").selectExpr("video_name", "9.0D as x", "y"), "video_name")
    assert {r.video_name: r.x for r in up.collect()} == {"a": 9.0, "b": 2.0}


# -- profiles

def test_histogram_edges(spark):
    v = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 5.0), (4, float("nan")), (5, None), (6, -99.0)], "k long, x double")
    axes = spark.createDataFrame([("x", 0.0, 10.0), ("none", 0.0, 1.0), ("flat", 2.0, 2.0)], "field string, min double, max double")
    values = P.tall(v, "k").unionByName(spark.createDataFrame([(1, "flat", 2.0)], "k long, field string, value double"))
    got = {(r.field, r.bin): r["count"] for r in P.histograms(values, axes, 4).collect()}
    assert [got["x", i] for i in range(4)] == [2, 0, 1, 1] and [got["none", i] for i in range(4)] == [0] * 4 and got["flat", 0] == 1
    assert sum(n for (f, _), n in got.items() if f == "x") == 4
    with pytest.raises(ValueError):
        P.histograms(values, axes, 1001)


def test_sequences(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 2.0), ("b", 1, 4.0), ("c", 1, None)], "k string, i int, v double")
    assert {r.k: r.variability for r in P.sequence_variability(df, "k", ["i"], "v").collect()} == {"a": 1.5, "b": 0.0, "c": 0.0}
    s = {r.k: (r["mean"], r["max"], r["min"], r["std"]) for r in P.sequence_summary(df, "k", "v").collect()}
    assert s["a"] == (2.0, 3.0, 1.0, 0.8165) and s["c"] == (0.0, 0.0, 0.0, 0.0)


def test_correlation_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "x double, y double, c double")
    got = {(r.x, r.y): round(r.r, 6) for r in P.correlations(df, ["x", "y", "c"]).collect()}
    assert got == {("x", "y"): 1.0, ("x", "c"): 0.0, ("y", "c"): 0.0}
    assert P.correlations(df, ["x"]).count() == 0


def test_words(spark):
    df = spark.createDataFrame([("The cat, the CAT! a dog",), ("dog-house",), (None,), ("",)], "caption string")
    got = {r.word: (r["count"], r.pct) for r in P.word_frequency(df, "caption").collect()}
    assert got == {"cat": (2, 0.25), "dog": (2, 0.5), "house": (1, 0.25)}
    assert P.word_frequency(df.limit(0), "caption").count() == 0


# -- vectors

def test_search_of_wide_and_narrow_vectors(spark):
    rng = np.random.default_rng(0)
    for width in (3, 300):
        m = rng.normal(size=(20, width))
        df = spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(m)] + [("null", None)], "video_name string, embedding array<float>")
        q = m[4]
        want = sorted(range(20), key=lambda i: -(m[i] @ q))[:5]
        assert [int(r.video_name) for r in V.top(df, list(q), 5).collect()] == want
        cos = m @ q / np.linalg.norm(m, axis=1) / np.linalg.norm(q)
        got = {r.video_name: r.score for r in V.scored(df, list(q), normalise=True).collect()}
        assert got["null"] is None and all(abs(got[str(i)] - cos[i]) < 1e-5 for i in range(20))
        twice = spark.createDataFrame([("1",), ("1",), ("2",), ("gone",)], "video_name string")
        c = 2 * m[1] + m[2]
        assert np.allclose(V.centroid(df, twice), c / np.linalg.norm(c), atol=1e-5)
        with pytest.raises(ValueError):
            V.centroid(df, twice.where("video_name = 'gone'"))


def test_diversity(spark):
    df = spark.createDataFrame([("o", [1.0, 0.0]), ("o", [0.0, 2.0]), ("s", [1.0, 1.0]), ("s", [3.0, 3.0]), ("one", [1.0, 0.0])], "g string, embedding array<double>")
    assert {r.g: r.diversity for r in V.diversity(df, "g").collect()} == {"o": 1.0, "s": 0.0, "one": None}


# -- the plan

def small(spark):
    entries = spark.createDataFrame([(1, "a", "red cat", "/a", 5.0), (2, "b", None, "/b", None), (3, "c", "red dog", "/c", 7.0)], "ordinal long, video_name string, caption string, source_path string, x double")
    meta = spark.createDataFrame([("a", 640.0, 1.0), ("c", 320.0, 2.0)], "video_name string, width double, x double")
    vectors = spark.createDataFrame([("clip", "a", [1.0, 0.0]), ("clip", "c", [0.6, 0.8]), ("clip", "z", [0.0, 1.0])], "prefix string, video_name string, embedding array<float>")
    return plan.Catalogue("small", entries, meta, None, vectors, spark.createDataFrame([("c",)], "video_name string"))


def test_text_search(spark):
    c = small(spark)
    r = plan.text_search(c, plan.Request(query="red", sort="x"), [2.0, 0.0])
    assert [(x.video_name, round(x.score, 3), x.x, x.width) for x in r.page.collect()] == [("c", 0.6, 7.0, 320.0), ("a", 1.0, 5.0, 640.0)]
    assert r.total == 2 and plan.text_search(c, plan.Request(query="red", ranges={"score": (0.9, None)}), [2.0, 0.0]).total == 1
    bins = {(b.field, b.bin): b["count"] for b in r.histograms(10).collect()}
    assert sum(n for (f, _), n in bins.items() if f == "score") == 2 and sum(n for (f, _), n in bins.items() if f == "width") == 2
    assert plan.text_search(c, plan.Request(favourites="only")).total == 1 and plan.text_search(c, plan.Request(thumbs="none")).total == 1
    assert plan.text_search(c, plan.Request(page=9)).page.count() == 0


def test_vector_searches(spark):
    c = small(spark)
    r = plan.semantic_search(c, plan.Request(), [0.0, 1.0])
    assert [(x.video_name, x.caption) for x in r.page.collect()] == [("z", ""), ("c", "red dog"), ("a", "red cat")]
    h = plan.centroid_search(c, plan.Request(), spark.createDataFrame([("a",)], "video_name string"))
    assert [x.video_name for x in h.page.collect()] == ["a", "c", "z"]
    assert [x.video_name for x in h.export().collect()] == ["a", "c", "z"]
    assert plan.detail(c, "b").first().x is None and plan.detail(c, "nobody").count() == 0
    with pytest.raises(ValueError):
        plan.Catalogue("none", c.entries).index("clip")


def test_request_round_trip():
    r = plan.Request("d", "a b", "gve", 3, 50, "x_y", "asc", "only", "none", 7, {"w": (1.0, None), "h": (None, 2.5)})
    assert plan.Request.parse(r.text()) == r and plan.Request().text() == "" and plan.Request.parse("") == plan.Request()
    assert S.sort_key("random") == ("random", "desc") and S.sort_key("a_b_asc") == ("a_b", "asc") and S.sort_key("x") == ("x", "desc")
    with pytest.raises(ValueError):
        plan.Request.parse("page=x")


# -- registry

def test_registry():
    r = model.standard()
    assert r.order(["clip"]) == ["compress", "ingest", "clip"] and r.enabled(["clip", "phash"], ["phash"]) == ["compress", "ingest", "clip"]
    assert set(r.spaces()) == {"clip", "siglip", "gve"} and r.spaces()["siglip"][1] == 1152
    assert [n for n, _ in r.rules()["vector_index"]] == ["clip", "gve", "siglip"]
    assert r.field_catalogue("ultravideo")["vtss_score"][0] == "ultravideo" and r.field_catalogue()["score"][1].dynamic
    assert "metadata.json" in r.artifact_catalogue()["data"] and model.config()["sprite_frames"] == 25
    for bad in (model.Processor("x", depends_on=("x",)), model.Processor("y", depends_on=("gone",))):
        with pytest.raises(ValueError):
            model.Registry([bad]).order()
    for clash in (model.Processor("clip"), model.Processor("z", fields={"fps": model.Field("f")}), model.Processor("z", artifacts={"clip.json": "data"}), model.Processor("z", space=("gve", 2))):
        with pytest.raises(ValueError):
            r.add(clash)
    with pytest.raises(ValueError):
        r.add_dataset(model.Dataset("d", fields={"score": model.Field("s")}))
    with pytest.raises(ValueError):
        r.known(["nobody"])
    with pytest.raises(ValueError):
        r.encode("clip", "text")
    e = model.Registry([model.Processor("e", space=("e", 2), encode=lambda q: [3.0, 4.0])])
    assert e.encode("e", "x") == [0.6, 0.8]
    s = model.Registry([model.Processor("a", sections=(model.Section("t", "late"),)), model.Processor("b", sections=(model.Section("t", "early", 5),))])
    assert [x.label for x in s.sections()] == ["early", "late"]
    assert model.sorted_fields(["fps", "height", "zzz", "width", "dyn"], ["dyn"]) == ["dyn", "height", "width", "fps", "zzz"]


def test_processors_run_in_order(spark):
    a = model.Processor("a", transform=lambda df: df.selectExpr("sample_id", "length(sample_id) as n"))
    b = model.Processor("b", depends_on=("a",), transform=lambda df: df.selectExpr("sample_id", "n * 2 as m"))
    out = model.Registry([a, b]).run(spark.createDataFrame([("xy",), ("z",)], "sample_id string"))
    assert {r.sample_id: r.m for r in out["b"].collect()} == {"xy": 4, "z": 2}


def test_steps_over_sequences(spark):
    from cinegrid.operators import processors as A

    rows = [("a", [1.0, 3.0, 2.0], [0, 1, 3], [[1.0, 0.0], [0.0, 2.0]]), ("b", [], [5], [[1.0, 1.0]]), ("c", None, None, None), ("d", [4.0], [7, 7], [[1.0, 0.0], [3.0, 0.0], [2.0, 0.0]])]
    df = spark.createDataFrame(rows, "sample_id string, magnitudes array<double>, hashes array<long>, frames array<array<double>>")
    got = {r[0]: tuple(r)[1:] for r in A.flow_fields(df).collect()}
    assert got["a"] == (2.0, 3.0, 1.0, 0.8165, 1.5) and got["b"] == got["c"] == (0.0, 0.0, 0.0, 0.0, 0.0) and got["d"] == (4.0, 4.0, 4.0, 0.0, 0.0)
    got = {r[0]: tuple(r)[1:] for r in A.hash_fields(df).collect()}
    assert got["a"] == (1.0, 1.0, 0.0, 0.0) and got["b"] == (0.0, 0.0, 0.0, 0.0) and got["d"] == (0.0, 0.0, 0.0, 0.0)
    got = {r[0]: r[1] for r in A.spread_field("clip")(df).collect()}
    assert got == {"a": 1.0, "b": None, "c": None, "d": 0.0}


def test_validation(spark):
    with pytest.raises(ValueError, match="caption"):
        model.validated(spark.createDataFrame([("a",)], "video_name string"))


# -- sources and sinks

def test_manifest_array_and_csv(spark, tmp_path):
    rows = [{"video_name": "a", "caption": 'x "y"\n', "source_path": "/a", "n": 1}, {"video_name": "b", "caption": None, "source_path": "/b", "n": 2.5}]
    (tmp_path / "manifest.json").write_text(json.dumps(rows))
    got = src.manifest(spark, str(tmp_path / "manifest.json"), ["n"]).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == [0, 1] and [(r.video_name, r.caption, r.n) for r in got] == [("a", 'x "y"\n', 1.0), ("b", None, 2.5)]
    (tmp_path / "c.csv").write_text('clip_id,Brief Description,Summarized Description,vtss_score,motion_score,video_clip_score\nu.mp4,"b,""q""\nx",, 0.5 ,,junk\nv.mp4,b,s,1,2,3\n')
    got = {r.video_name: r for r in src.ultra_entries(src.csv(spark, str(tmp_path / "c.csv"))).collect()}
    assert (got["u"].caption, got["u"].vtss_score, got["u"].motion_score, got["u"].video_clip_score) == ('b,"q"\nx', 0.5, None, None) and got["v"].caption == "s"
    listed = spark.createDataFrame([("v", "/v")], "video_name string, path string")
    assert [r.source_path for r in src.ultra_entries(src.csv(spark, str(tmp_path / "c.csv")), listed).collect()] == ["/v"]


def test_nested_file(spark, tmp_path):
    leaf = lambda n, p, c: {"video_name": n, "cleancode_pexels_path": p, "video_caption": c}
    (tmp_path / "n.json").write_text(json.dumps({"g": {"1": leaf("a", "/a", ["x", "y"]), "2": leaf("", "/b", []), "3": leaf("c", "/c", [])}, "h": {"1": leaf("a", "/z", ["late"]), "2": leaf("d", None, None)}}))
    got = {r.video_name: (r.caption, r.source_path) for r in src.nested(spark, str(tmp_path / "n.json")).collect()}
    assert got == {"a": ("x", "/a"), "c": ("", "/c")}


def test_sample_folders(spark, tmp_path):
    for sid, files in (("d_a", {"origins.json": b"{}", "metadata.json": b'{"width": 3}', "v.npy": None}), ("d_b", {"metadata.json": b"{}"}), ("d_c", {"origins.json": b"{}", "v.npy": b"broken"})):
        at = tmp_path / "1b" / "e5" / sid
        at.mkdir(parents=True)
        for name, body in files.items():
            if body is None:
                f = io.BytesIO()
                np.save(f, np.arange(3, dtype=np.float16))
                body = f.getvalue()
            (at / name).write_bytes(body)
    found = src.samples(src.listing(spark, str(tmp_path)))
    assert {r.sample_id for r in found.collect()} == {"d_a", "d_c"}
    meta = src.json_artifact(found.select("sample_id"), src.artifacts(spark, str(tmp_path), "metadata.json").withColumnRenamed("content", "body"), "width double")
    assert {r.sample_id: r.width for r in meta.collect()} == {"d_a": 3.0, "d_c": None}
    vectors = {r.sample_id: r.embedding for r in src.npy_artifact(src.artifacts(spark, str(tmp_path), "v.npy")).collect()}
    assert vectors == {"d_a": [0.0, 1.0, 2.0], "d_c": None}
    assert R.incomplete(found, spark.createDataFrame([("d_a", "x"), ("d_a", "y"), ("d_c", "x")], "sample_id string, artifact string"), ["x", "y"]).collect()[0].sample_id == "d_c"


def test_images_that_fail_are_left_out(spark):
    def load():
        def model_(images):
            if any(b == b"bad" for b in images):
                raise OSError("bad")
            return np.array([[len(b), 0.0] for b in images])
        return model_

    df = spark.createDataFrame([("a", bytearray(b"xx")), ("b", bytearray(b"bad")), ("c", bytearray(b""))], "k string, image binary")
    assert {r.k: r.embedding for r in src.encode_images(df, "k", "image", load).withColumnRenamed("key", "k").collect()} == {"a": [1.0, 0.0]}


def test_favourites_and_rendering(spark, tmp_path):
    have = spark.createDataFrame([("d", "a"), ("e", "a")], "dataset string, video_name string")
    names = spark.createDataFrame([("a",), ("b",), ("b",)], "video_name string")
    key = lambda df: sorted((r.dataset, r.video_name) for r in df.collect())
    assert key(sinks.favourites(have, "d", names, "add")) == [("d", "a"), ("d", "b"), ("e", "a")] and key(sinks.favourites(have, "d", names, "remove")) == [("e", "a")]
    with pytest.raises(ValueError):
        sinks.favourites(have, "d", names, "toggle")
    assert json.loads(sinks.as_json(have.limit(1)).first().text) == {"dataset": "d", "video_name": "a"}
    path = f"file://{tmp_path}/t"
    sinks.staged(have, path, files=1)
    sinks.staged(spark.read.parquet(path).where("dataset = 'd'"), path)
    assert spark.read.parquet(path).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_sizes_and_numbers(spark):
    df = spark.createDataFrame([(0,), (100,), (1024,), (1025,), (10_000_000,), (1 << 30,), (None,)], "n long")
    assert [r[0] for r in df.select(S.file_size(df.n)).collect()] == ["0B", "100B", "1KB", "1.0KB", "9.5MB", "1GB", None]
    df = spark.createDataFrame([(480, 1920, 1080), (480, 640, 360), (480, 1080, 1920), (144, None, 5)], "t int, w int, h int")
    got = [r[0] for r in df.where("t = 480").select(S.target_size(df.w, df.h, 480)).collect()]
    assert [(g.width, g.height) for g in got] == [(854, 480), (640, 360), (480, 854)]


def test_parts_datasets_and_vectors_on_disk(spark, tmp_path):
    base = f"file://{tmp_path}"
    assert src.csv_parts(spark, f"{base}/none", ["part_001"]).count() == 0
    for n in (1, 2, 10):
        (tmp_path / f"OpenHumanVid_part_{n:03d}.csv").write_text(f'path,clip_id\n/p{n},"c,{n}"\n')
    (tmp_path / "OpenHumanVid_part_002.csv").write_bytes(b"\xff broken")
    got = {(r.clip_id, r.part) for r in src.csv_parts(spark, base, ["part_001", "part_010", "part_099"]).collect()}
    assert got == {("c,1", "part_001"), ("c,10", "part_010")}
    assert src.csv_lines(spark, f"{base}/OpenHumanVid_part_001.csv").count() == 1
    for name, files in (("a", ["manifest.json"]), ("b", []), ("c", ["other"])):
        (tmp_path / "d" / name).mkdir(parents=True)
        for f in files:
            (tmp_path / "d" / name / f).write_text("[]")
    assert src.datasets(spark, f"{base}/d", ["z"]) == ["a", "z"] and src.datasets(spark, f"{base}/gone") == []
    with pytest.raises(ValueError):
        src.vector_index(spark, f"{base}/gone")
    rows = spark.createDataFrame([("x", [1.0]), (None, None)], "video_name string, embedding array<double>")
    sinks.vector_view(rows, f"{base}/v/clip")
    found, prefixes = src.vector_index(spark, f"{base}/v")
    assert prefixes == ("clip",) and found.count() == 2
    with pytest.raises(ValueError, match="there are"):
        plan.Catalogue("c", rows, vectors=found, prefixes=prefixes).index("gve")
    assert sinks.load_favourites(spark, f"{base}/f").count() == 0


def test_scatter_and_scope(spark):
    from cinegrid import scratch

    rows = spark.createDataFrame([(i, f"n{i}", "c", "p", None if i % 5 == 0 else float(i)) for i in range(60)], "ordinal long, video_name string, caption string, source_path string, a double")
    side = spark.createDataFrame([(f"n{i}", float(-i)) for i in range(0, 60, 2)], "video_name string, b double")
    result = plan.text_search(plan.Catalogue("c", rows, side), plan.Request())
    before = len(scratch._written)
    with scratch.scope():
        got = {(r.x, r.y) for r in plan.scatter(result, "a", "b", 100).collect()}
        assert got == {(float(i), float(-i)) for i in range(0, 60, 2) if i % 5} and len(scratch._written) > before
        assert plan.scatter(result, "a", "a", 30, 3).count() <= 30 and plan.scatter(result, "a", "gone").count() == 0
    assert len(scratch._written) == before


def test_plugins_that_fail_are_named(tmp_path):
    (tmp_path / "a.py").write_text("1 / 0")
    with pytest.raises(ValueError, match="a.py"):
        model.discovered(str(tmp_path))
    assert not model.discovered(str(tmp_path / "none")).processors


def test_geometry_and_rounding(spark):
    df = spark.createDataFrame([(11, 7, 2.5), (None, 5, None), (3, 3, 0.125)], "w int, h int, v double")
    got = df.select(S.grid_cells(df.w, df.h, 2, 3).alias("g"), S.half_even(df.v, 0).alias("a"), S.half_even(df.v, 2).alias("b"), S.composed(df.w, 10, 20, 5).alias("c")).collect()
    assert [tuple(x) for x in got[0].g] == [(0, 0, 5, 2), (5, 0, 5, 2), (0, 2, 5, 2), (5, 2, 5, 2), (0, 4, 5, 2), (5, 4, 5, 2)] and got[1].g is None
    assert [r.a for r in got] == [2.0, None, 0.0] and got[2].b == 0.12
    assert (got[0].c.width, got[0].c.height, tuple(got[0].c.cells[10])) == (50, 60, (0, 40)) and got[1].c is None


def test_steps_with_a_stand_in_model(spark):
    def load():
        return lambda images: np.array([[float(len(b)), 1.0] for b in images])

    rows = [("a", 1920, 1080, 50, 25.0, None, 10, [b"x", b"xyz"]), ("b", None, None, None, None, None, None, None), ("c", 100, 90, None, 0.0, 2.0, 0, [])]
    df = spark.createDataFrame(rows, "sample_id string, width int, height int, raw_frames int, rate double, seconds double, bytes long, images array<binary>")
    out = model.standard({"clip": load}).run(df, ["clip"])
    sizes = {r.sample_id: r.sizes for r in out["compress"].collect()}
    assert list(sizes["a"]) == [144, 240, 360, 480, 720, 1080] and (sizes["a"][480].width, sizes["a"][480].height) == (854, 480) and not sizes["b"] and not sizes["c"]
    media = {r.sample_id: r for r in out["ingest"].collect()}
    assert media["a"].num_frames == 50 and media["a"].frames[-1] == 49 and media["b"].frames == [] and (media["c"].num_frames, media["c"].fps) == (60, 30.0)
    clip = out["clip"].collect()
    assert [r.sample_id for r in clip] == ["a"] and abs(sum(x * x for x in clip[0].clip_embedding) - 1) < 1e-6 and clip[0].clip_std > 0


# -- incremental views

def fragments(spark, rows):
    return spark.createDataFrame(rows, "video_name string, at int, x double, y double")


def test_views(spark, tmp_path):
    rows = [("a", 1, 1.0, None), ("a", 2, 2.0, 5.0), ("b", 1, None, None), (None, 1, 9.0, 9.0), ("c", 1, 3.0, None)]
    whole, parts = inc.View(spark, f"file://{tmp_path}/w"), inc.View(spark, f"file://{tmp_path}/p")
    assert whole.read() is None and inc.status({"w": whole}) == {"w": 0}
    whole.take(fragments(spark, rows), ["at"])
    for r in rows:
        parts.take(fragments(spark, [r]), ["at"])
    read = lambda v: sorted((r.video_name, r.x, r.y) for r in v.read().collect())
    assert read(whole) == read(parts) == [("a", 2.0, 5.0), ("c", 3.0, None)]
    before = read(parts)
    parts.take(fragments(spark, rows), ["at"])
    assert read(parts) == before and sorted(r.video_name for r in parts.included().collect()) == ["a", "c"]
    # an artifact that comes late is taken in, whatever another rule has done
    late = fragments(spark, [("b", 2, 7.0, None)])
    assert set(inc.aggregate({"p": (parts, ["at"]), "w": (whole, ["at"])}, {"p": late, "w": fragments(spark, rows)})) == {"p", "w"}
    assert ("b", 7.0, None) in read(parts)
    parts.take(late, ["at"], rebuild=True)
    assert read(parts) == [("b", 7.0, None)]
    vectors = inc.View(spark, f"file://{tmp_path}/v", "vector_index")
    vectors.take(fragments(spark, rows), ["at"])
    vectors.take(fragments(spark, [("a", 9, None, 8.0)]), ["at"])
    assert read(vectors) == [("a", None, 8.0), ("c", 3.0, None)]
    with pytest.raises(ValueError):
        inc.View(spark, "x", "other")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"n{i % 7}", i, float(i), None) for i in range(50)]
    for k in range(3):
        fragments(spark, rows[k::3]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    view = inc.View(spark, f"file://{tmp_path}/view")
    source = spark.readStream.schema("video_name string, at int, x double, y double").option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a restart finds nothing new
        inc.stream(source, view, ["at"], f"file://{tmp_path}/checkpoint").awaitTermination()
    batch = inc.View(spark, f"file://{tmp_path}/batch")
    batch.take(fragments(spark, rows), ["at"])
    key = lambda v: sorted((r.video_name, r.x) for r in v.read().collect())
    assert key(view) == key(batch) and view.state()["version"] == 1


def test_a_run_that_ends_anywhere_loses_nothing(spark, tmp_path, monkeypatch):
    """Whatever file operation a run dies at, the version before it is read, and the batch can be taken in again."""
    first, second = [("a", 1, 1.0, None), ("b", 1, 2.0, None)], [("b", 2, 3.0, 4.0), ("c", 1, 5.0, None)]
    read = lambda v: sorted((r.video_name, r.x, r.y) for r in v.read().collect())
    for fatal in range(6):
        view = inc.View(spark, f"file://{tmp_path}/v{fatal}")
        view.take(fragments(spark, first), ["at"])
        left = [fatal]

        def dying(work):
            def run(*args):
                if not left[0]:
                    raise RuntimeError("killed")
                left[0] -= 1
                return work(*args)

            return run

        with monkeypatch.context() as m:
            for name in ("_write", "_write_buckets", "_rename"):
                m.setattr(inc, name, dying(getattr(inc, name)))
            m.setattr(inc.View, "_clean", dying(inc.View._clean))
            try:
                view.take(fragments(spark, second), ["at"])
                assert fatal >= 5
            except RuntimeError:
                assert fatal < 5
        again = inc.View(spark, view.path)
        old = [("a", 1.0, None), ("b", 2.0, None)]
        new = [("a", 1.0, None), ("b", 3.0, 4.0), ("c", 5.0, None)]
        assert read(again) == (new if fatal >= 4 else old)
        for _ in range(2):
            again.take(fragments(spark, second), ["at"])
            assert read(again) == new and again.state()["count"] == 3
        assert sorted(r.video_name for r in again.included().collect()) == ["a", "b", "c"]


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inc, "PARTS", 4)
    view = inc.View(spark, f"file://{tmp_path}/v", buckets=8)
    view.take(fragments(spark, [(f"n{i}", 1, 1.0, None) for i in range(60)]), ["at"])
    before = view.state()["buckets"]
    served = inc.Served(view)
    view.take(fragments(spark, [("n3", 2, 2.0, None)]), ["at"])
    after = view.state()
    assert sum(before[b] != after["buckets"][b] for b in before) == 1 and after["count"] == 60
    assert served.table.where("x = 2").count() == 0 and served.reload() and served.table.where("x = 2").count() == 1 and not served.reload()
    # empty batches, many versions, and a new field
    assert view.take(fragments(spark, []), ["at"])["count"] == 60
    for i in range(6):
        view.take(spark.createDataFrame([(f"m{i}", 1, "z")], "video_name string, at int, z string"), ["at"])
    assert view.read().count() == 66 == view.included().count() and view.read().where("z = 'z'").count() == 6
    assert len(view.versions()) == inc.KEPT and len(view.state()["included"]) <= inc.PARTS
    empty = inc.View(spark, f"file://{tmp_path}/e")
    empty.take(fragments(spark, []), ["at"])
    assert empty.read().count() == 0 == empty.included().count()


def test_views_are_found_and_counted(spark, tmp_path):
    folder = f"file://{tmp_path}/views"
    for name in ("video_stats", "extra"):
        inc.View(spark, f"{folder}/{name}").take(fragments(spark, [("a", 1, 1.0, None), (name, 1, 1.0, None)]), ["at"])
    assert list(inc.load(spark, folder)) == ["video_stats"]
    inc.save_targets(spark, folder, ["extra.json", "video_stats", "missing"])
    views = inc.load(spark, folder)
    assert list(views) == ["extra.json", "video_stats"]
    assert {r["key"]: r["count"] for r in inc.status_record(spark, views).collect()} == {"total_samples": 3, "extra": 2, "video_stats": 2}
    assert inc.load(spark, f"{folder}/none") == {}
