"""What the plans of stored, pushed and SQL-defined work look like."""

import os
import re
import tempfile

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from checks import evaluation, files, geometry, registry, tables, text
from gapfield.functions import sql as sql_functions
from gapfield.operators import blocks, candidates, hessian, nearest
from gapfield.operators import query as Q
from gapfield.plans import evaluate
from gapfield.sources import field_files, field_source, store
from gapfield.streaming.audit import ObservedGroups
from gapfield.streaming.sink import append_stream, read_appended


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_voxels_stay_in_their_buckets(spark):
    own, v = files.bucketed(spark, DATA, tables.sphere_voxels)
    d = Q.query(tables.sphere_points(own, DATA), tables.sphere_fields(own, DATA), v, "first")
    text_ = plan(d)
    assert "Bucketed: true" in text_ and "BroadcastHashJoin" not in text_
    # from the bucketed scan up to its join there is a sort at most
    lines = text_.splitlines()
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = lambda line: re.search(r"[A-Za-z]", line).start()
    above, now = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < now:
            above.append(line)
            now = depth(line)
            if "Join" in line:
                break
    assert "_block" in above[-1] and not any("Exchange" in x for x in above)


def test_cells_made_for_buckets_are_written_without_a_second_shuffle(spark, scratch):
    v, n, name = tables.sphere_voxels(spark, DATA, hess=False), 5, "gf_dealt_cells"
    cells = Q.cell_table(v, buckets=n)
    store.write_bucketed(cells, name, scratch + "/cells", n, dealt=True)
    try:
        got = spark.table(name)
        own = F.expr(f"pmod(hash(field_id, {Q.STORED}), {n})")
        named = F.regexp_extract(F.input_file_name(), "_([0-9]{5})[.]", 1).cast("int")
        seen = got.select(own.alias("own"), named.alias("named"), F.input_file_name().alias("file")).distinct().collect()
        assert seen and all(r.own == r.named for r in seen) and len(seen) == len({r.named for r in seen})
        assert got.drop(Q.STORED).exceptAll(Q.cell_table(v)).count() == 0 and got.count() == Q.cell_table(v).count()
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_second_derivatives_take_one_shuffle_of_voxels(spark):
    v, f = tables.sphere_voxels(spark, DATA, hess=False), tables.sphere_fields(spark, DATA)
    own = spark.createDataFrame(v.collect(), v.schema)
    text_ = plan(hessian.hessian(own, f))
    assert "Window" not in text_ and text_.count("MapInArrow") == 1
    below = text_[text_.index("MapInArrow") :]
    assert len(re.findall(r"Exchange hashpartitioning\(field_id[^)]*_b0", below)) == 1


@pytest.mark.parametrize("dims", [(20, 9, 8), (1, 1, 17)])
def test_block_arrays_see_all_neighbours(spark, dims):
    import numpy as np

    r = np.random.default_rng(1)
    values = {}
    rows = []
    for f in ("a", "b"):
        for at in np.ndindex(*dims):
            if r.random() < 0.8:
                values[f, *at] = r.normal(size=3)
                rows.append((f, *map(int, at), *map(float, values[f, *at])))
    spec = spark.createDataFrame([("a", 0.5, 1.0, 2.0), ("b", 1.0, 1.0, 1.0)], "field_id string, voxx double, voxy double, voxz double")
    v = spark.createDataFrame(rows, "field_id string, i int, j int, k int, nx double, ny double, nz double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = hessian.hessian(v, spec).collect()
        cells = Q.cell_table(v.withColumn("phi", F.col("nx") * 2), cubic=False).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    size = {"a": (0.5, 1.0, 2.0), "b": (1.0, 1.0, 1.0)}
    for x in got[::7]:
        key = (x.field_id, x.i, x.j, x.k)
        own = values[key]
        d = []
        for a in range(3):
            step = [0, 0, 0]
            step[a] = 1
            hi, lo = (values.get((x.field_id, *(p + s * q for p, q in zip(key[1:], step))), own) for s in (1, -1))
            d.append((hi - lo) / (2 * size[x.field_id][a]))
        for m, n, name in ((0, 0, "hxx"), (0, 1, "hxy"), (0, 2, "hxz"), (1, 2, "hyz"), (2, 2, "hzz")):
            assert x[name] == pytest.approx((d[n][m] + d[m][n]) / 2, abs=1e-12)
    want = {k for k in values if all((k[0], k[1] + a, k[2] + b, k[3] + c) in values for a, b, c in Q.CORNERS)}
    assert {(c.field_id, c.i, c.j, c.k) for c in cells} == want
    for c in cells:
        assert c.phi_101 == 2 * values[c.field_id, c.i + 1, c.j, c.k + 1][0]
    assert blocks.DIM == 8


def test_source_reads_only_what_filters_ask_for(spark):
    folder = files.written(spark, DATA)
    d = files._source(spark, folder, "voxels").where("field_id = '1' and bk >= 1 and phi > 0")
    assert "bk" in plan(d) and "field_files" in plan(d).lower()
    reader = field_source.FieldReader({"path": f"{folder}/*.sdf"})
    every = reader.partitions()
    left = list(reader.pushFilters([field_source.EqualTo(("field_id",), "1"), field_source.GreaterThanOrEqual(("bk",), 1), field_source.EqualTo(("phi",), 0.0)]))
    few = reader.partitions()
    assert len(left) == 3 and len(reader.pushed) == 2 and 0 < len(few) < len(every) and {p.head["field_id"] for p in few} == {"1"}
    whole = next(p for p in every if p.head["field_id"] == "1")
    assert few[0].first > 0 and few[0].first + few[0].count == whole.count
    rows = d.collect()
    assert rows and all(r.field_id == "1" and r.bk >= 1 and r.phi > 0 and r.wx is None for r in rows)
    assert field_files.HEADER.size > 0


def test_sql_functions_are_part_of_the_plan(spark):
    names = sql_functions.register(spark)
    assert {"gf_closest_point", "gf_voxels", "gf_snap"} <= set(names)
    p = plan(text.sql_closest_point(spark, DATA))
    assert "Python" not in p and "gf_" not in p.replace("gf_check", "")
    got = spark.sql("select gf_snap(33L, 512L) a, gf_snap(3000L, 512L) b, gf_block_key(named_struct('i', 9L, 'j', 17L, 'k', 1L), 8L) c").first()
    assert (got.a, got.b, got.c) == (64, 512, 1 + (2 << 21))


def test_observed_rows_wait_for_their_job(spark):
    d = spark.range(100).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("kind"), "id")
    seen = ObservedGroups("kinds", "kind", ["x", "y", "z"], {"n": lambda own: F.count_if(own), "most": lambda own: F.max(F.when(own, F.col("id")))})
    seen.through(d).write.format("noop").mode("overwrite").save()
    assert {tuple(r) for r in seen.rows(spark).collect()} == {("x", 34, 99), ("y", 66, 98), ("z", 0, None)}


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_a_batch_that_runs_again_is_written_once(spark, fmt):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.range(30).selectExpr("id", "id * 2 as twice")
    for k in range(3):
        rows.where(f"id % 3 = {k}").write.mode("append").parquet(root + "/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(root + "/in")
    failed = []

    def fail(batch_id):
        if not failed:
            failed.append(batch_id)
            raise RuntimeError("stopped on purpose")

    q = append_stream(stream, root + "/out", root + "/state", fmt, after=fail)
    with pytest.raises(Exception, match="stopped on purpose"):
        q.awaitTermination()
    append_stream(stream, root + "/out", root + "/state", fmt, after=fail).awaitTermination()
    got = read_appended(spark, root + "/out", rows.schema, fmt).select("id", "twice").collect()
    assert sorted((r.id, r.twice) for r in got) == [(i, 2 * i) for i in range(30)] and failed == [0]


def test_a_session_of_ones_own_leaves_the_given_one_alone(spark):
    own = registry.session_with(spark, **{"spark.sql.shuffle.partitions": "3"})
    assert own.conf.get("spark.sql.shuffle.partitions") == "3" and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_convergence_without_series_has_no_nested_loop(spark):
    from gapfield.operators import contact

    rows = [(10.0, 0.4, 0.5, 0.52), (20.0, 0.2, 0.5, 0.51), (40.0, 0.11, 0.5, 0.502)]
    d = spark.createDataFrame(rows, "n double, torque_error double, radius_exact double, spin_radius double")
    c = contact.convergence(d, F.col("n"))
    assert "NestedLoop" not in plan(c) and "Cartesian" not in plan(c)
    assert [r.reference for r in c.orderBy("size").collect()] == pytest.approx([0.4, 0.2, 0.1])


def test_sides_grown_from_few_rows_are_not_broadcast(spark):
    """Spark sizes an exploded table by what it was exploded from; a voxel table must not pass the driver for that."""
    pts, f, v = tables.sphere_points(spark, DATA), tables.sphere_fields(spark, DATA), tables.sphere_voxels(spark, DATA)
    cand, cells = tables.sphere_candidates(spark, DATA), Q.cell_table(v)
    asked = {
        "first": {}, "second": {}, "trilinear": {}, "tricubic": {}, "trilinear cells": {"cells": cells}, "tricubic cells": {"cells": cells},
        "candidates": {"candidates": cand}, "candidates table": {"cells": cells, "table": Q.candidate_table(v, cand)},
    }
    for mode, more in asked.items():
        text = plan(Q.query(pts, f, v, mode.split()[0], **more))
        assert not grown_and_broadcast(text), mode
    assert not grown_and_broadcast(plan(tables.narrow_band(v)))
    poses, contacts = evaluation.moving_bodies(spark, DATA)
    assert not grown_and_broadcast(plan(evaluate.pair_poses(contacts, poses)))


def grown_and_broadcast(text: str) -> list[str]:
    """The broadcasts of a plan that hold an explode."""
    lines = text.splitlines()
    depth = [len(re.match(r"[\s:+*|-]*(\(\d+\) )?", x).group()) - len(re.match(r"[\s:+*|-]*(\(\d+\) )?", x).group(1) or "") for x in lines]
    out = []
    for n, x in enumerate(lines):
        if "BroadcastExchange" not in x:
            continue
        end = next((m for m in range(n + 1, len(lines)) if depth[m] <= depth[n]), len(lines))
        out += [x for y in lines[n + 1 : end] if re.search(r"\bGenerate ", y)]
    return out


def test_candidate_pairs_are_neither_sorted_nor_stored(spark):
    pts, tris = tables.mesh_points(spark, DATA).limit(200).localCheckpoint(), tables.tris(spark, DATA)
    own = candidates.pairs_within(pts, tris, F.lit(0.05), 0.25)
    assert "Window" not in plan(own)
    want = candidates.within_tolerance(candidates.near_pairs(pts, tris, 0.25), F.lit(0.05), ["mesh_id", "qid"], reach=0.25)
    key = ["mesh_id", "qid", "tri_id", "dist", "phi"]
    rows = sorted(want.select(*key).collect())
    assert rows and sorted(own.select(*key).collect()) == rows


def test_candidate_topk_sorts_no_window_over_all_pairs(spark):
    text_ = plan(geometry.candidate_topk(spark, DATA))
    assert len(re.findall(r"\bWindow \[", text_)) == 1


def test_points_are_not_joined_by_a_broadcast_of_all_orders(spark):
    """Spark sizes the totals of the line items by the compressed columns they are read from; in memory they take many times that."""
    for d in (tables.sphere_points(spark, DATA), registry.QUERIES["surface_accuracy"](spark, DATA)):
        text = plan(d)
        assert "SortMergeJoin" in text
        assert not [x for x in broadcast_parts(text) if "lineitem" in x or "l_orderkey" in x]


def broadcast_parts(text: str) -> list[str]:
    """The parts of a plan below its broadcasts."""
    lines = text.splitlines()
    depth = [len(re.match(r"[\s:+*|-]*", x).group()) for x in lines]
    out = []
    for n, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((m for m in range(n + 1, len(lines)) if depth[m] <= depth[n]), len(lines))
            out.append("\n".join(lines[n + 1 : end]))
    return out


def test_nearest_triangles_are_found_without_sorting_the_pairs(spark):
    """The smallest of (distance, id) is a sort aggregate over all pairs of points and triangles; plain numbers are hashed."""
    for name in ("nearest_triangle", "signed_distance"):
        text = plan(registry.QUERIES[name](spark, DATA))
        pairs = [x for x in text.splitlines() if "SortAggregate" in x and "d2" in x]
        assert not pairs and "_least" in text


def test_points_of_a_search_are_not_broadcast(spark):
    text = plan(registry.QUERIES["nearest_triangle"](spark, DATA))
    assert not [x for x in broadcast_parts(text) if "_tx" in x and "AS qid" in x]


def test_many_triangles_are_shuffled_with_the_same_result(spark, monkeypatch):
    near = lambda: sorted(map(tuple, registry.QUERIES["nearest_triangle"](spark, DATA).collect()))
    few = near()
    monkeypatch.setattr(nearest, "FEW", 0)
    assert near() == few and len(few) == tables.mesh_points(spark, DATA).count()


def test_many_files_share_partitions(spark, scratch, monkeypatch):
    folder = files.written(spark, DATA)

    def rows(reader):
        return sorted(tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.select(["field_id", "i", "j", "k", "phi"]).to_pylist())

    def reader(*filters):
        r = field_source.FieldReader({"path": f"{folder}/*.sdf"})
        list(r.pushFilters(list(filters)))
        return r

    low = field_source.LessThan(("bk",), 1)
    every, below, many = rows(reader()), rows(reader(low)), len(reader().partitions())
    monkeypatch.setattr(field_source, "PLANNED", 0)
    assert many > 1 == len(reader().partitions())
    assert rows(reader()) == every and rows(reader(low)) == below and 0 < len(below) < len(every)
    # the import lists a folder once; what lies in folders below is not meant
    os.makedirs(f"{scratch}/x=1")
    for name in [f"{n}.sdf" for n in range(40)] + ["x=1/40.sdf", "41.txt"]:
        with open(f"{scratch}/{name}", "wb") as f:
            f.write(b"SDFO")
    listed = field_files._files(spark, f"{scratch}/*.sdf")
    assert sorted(r.path.rsplit("/", 1)[1] for r in listed.collect()) == sorted(f"{n}.sdf" for n in range(40))
    assert listed.rdd.getNumPartitions() <= 8 and "41.txt" not in str(listed.inputFiles())


def test_copies_of_a_box_and_a_triangle_are_met_once_by_rays(spark):
    t = tables.tris(spark, DATA)
    copies = t.withColumn("tri_id", F.explode(F.array(*[F.col("tri_id") + 10_000 * n for n in range(3)])))
    p = tables.mesh_points(spark, DATA).limit(200)
    for search, name, cols in ((nearest.ray_parity, "hits", t.columns), (nearest.ray_boxes, "boxes", ["mesh_id", *[f"{q}{a}" for q in ("bmin", "bmax") for a in "xyz"]])):
        one = {(r.mesh_id, r.qid): r[name] for r in search(p, t.select(cols)).collect()}
        three = search(p, copies.select(cols))
        assert {(r.mesh_id, r.qid): r[name] for r in three.collect()} == {k: 3 * n for k, n in one.items()} and max(one.values()) > 0
        assert "count(1)" in three._jdf.queryExecution().optimizedPlan().toString()


def _scattered(spark):
    """Two fields of 20 x 9 x 8 voxels with holes, unlike points on and beside them, one of an unknown and one of no field."""
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(f, *map(int, at), *map(float, r.normal(size=4))) for f in (1, 2) for at in np.ndindex(20, 9, 8) if r.random() < 0.97]
    v = spark.createDataFrame(rows, "field_id bigint, i int, j int, k int, phi double, nx double, ny double, nz double")
    spec = {f"{q}{a}": F.lit(x) for q, x in (("bmin", 0.0), ("vox", 0.5)) for a in "xyz"} | {f"dim{a}": F.lit(n) for a, n in zip("xyz", (20, 9, 8))}
    fields = spark.createDataFrame([(1,), (2,)], "field_id bigint").withColumns(spec)
    at = r.uniform(-0.6, [10.6, 5.1, 4.6], size=(600, 3))
    points = [((1, 2, 2, 7, None)[q % 5], q % 50, *map(float, p)) for q, p in enumerate(at)]
    return v, fields, spark.createDataFrame(points, "field_id bigint, qid bigint, x double, y double, z double")


def test_corners_are_read_from_blocks_and_never_become_rows(spark):
    v, fields, points = _scattered(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        for mode in ("trilinear", "tricubic"):
            d = Q.query(points, fields, v, mode)
            text_ = plan(d)
            assert "Aggregate" not in text_ and len(re.findall(r"Exchange hashpartitioning\(field_id[^)]*_b0", text_)) == 1
            names = ["gap", "nx", "ny", "nz", "gx", "gy", "gz"]
            key = lambda x: (x.field_id or 0, x.qid, x.x)
            got, want = (sorted(a.collect(), key=key) for a in (d, Q.query(points, fields, mode=mode, cells=Q.cell_table(v, mode == "tricubic"))))
            assert len(got) == len(want) == 600 and 50 < sum(x.valid for x in got) < 360
            for x, y in zip(got, want):
                assert x.valid == y.valid
                assert [x[n] for n in names] == (pytest.approx([y[n] for n in names], abs=1e-9) if x.valid else [None] * 7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_modes_in_one_pass_equal_single_modes(spark):
    v, fields, points = _scattered(spark)
    for c in ("hxx", "hxy", "hxz", "hyy", "hyz", "hzz"):
        v = v.withColumn(c, F.sin(F.col("i") * 3.0 + F.col("j") * 2.0 + F.col("k") + len(c)))
    modes = ("first", "second", "trilinear", "tricubic")
    one = Q.query_modes(points, fields, v, modes)
    assert len(re.findall(r"Exchange hashpartitioning\(field_id[^)]*_b0", plan(one))) == 1
    names = ["gap", "nx", "ny", "nz", "wx", "wy", "wz"]
    key = lambda x: (x.mode, x.field_id or 0, x.qid, x.valid, x.gap or 0)
    got, want = (sorted(d.collect(), key=key) for d in (one, Q.stack_modes(**{m: Q.query(points, fields, v, m) for m in modes})))
    assert len(got) == len(want) == 2400
    for x, y in zip(got, want):
        assert (x.mode, x.field_id, x.qid, x.valid) == (y.mode, y.field_id, y.qid, y.valid)
        assert [x[n] for n in names] == (pytest.approx([y[n] for n in names], abs=1e-9) if x.valid else [None] * 7)


def test_points_and_boxes_are_spread_before_they_grow_into_pairs(spark):
    for make, sides in ((geometry.points_in_radius, 1), (geometry.point_in_box, 1), (geometry.box_overlap_pairs, 2)):
        assert plan(make(spark, DATA)).count("REPARTITION_BY_NUM") >= sides, make


def test_nearest_search_sorts_and_shuffles_no_pairs(spark, monkeypatch):
    """Full tiles dealt in shares and triangles too many to broadcast give the same answers."""
    points, tris = tables.mesh_points(spark, DATA), tables.tris(spark, DATA)
    pyramid = nearest.staged_cells(tris, 2)
    want = {x.qid: x.tri_id for x in nearest.nearest_triangle(points, tris, pyramid=pyramid).collect()}
    monkeypatch.setattr(nearest, "FEW", 0)
    monkeypatch.setattr(nearest, "SHARE", 2)
    d = nearest.nearest_triangle(points, tris, pyramid=pyramid)
    text_ = plan(d)
    # the key of a point alone never deals rows again, and no window sorts what tiles meet
    assert "Window" not in text_ and "_share" in text_ and not re.search(r"Exchange hashpartitioning\(mesh_id[^,]*, qid", text_)
    assert len(want) == points.count() and {x.qid: x.tri_id for x in d.collect()} == want


def test_contact_points_are_answered_in_blocks_and_never_shuffled(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "SHARE", 1)
    v, fields, asked = _scattered(spark)
    fields = fields.withColumns({f"bmax{a}": F.lit(x) for a, x in zip("xyz", (10.0, 4.5, 4.0))})
    cells = Q.cell_table(v, cubic=False)
    rest = {f"{q}{a}": F.lit(0.0) for q in "rvo" for a in "xyz"} | {f"r{r}{c}": F.lit(float(r == c)) for r in range(3) for c in range(3)}
    poses = spark.range(2).select(F.lit("r").alias("run_id"), F.lit(0.0).alias("t"), F.col("id").alias("body_id")).withColumns(rest)
    ones = {n: F.lit(1.0) for n in ("k", "mu", "k_order", "damping", "regularizer")}
    contacts = spark.createDataFrame([(1, 1), (2, 2), (3, 77)], "cp_id bigint, field_id bigint").withColumns({"body_a": F.lit(0).cast("bigint"), "body_b": F.lit(1).cast("bigint"), "mesh_id": F.lit("m"), **ones})
    q = asked.select(F.lit("m").alias("mesh_id"), F.monotonically_increasing_id().alias("qid"), "x", "y", "z", F.lit(1.0).alias("w")).localCheckpoint()
    d = evaluate.contact_points(poses, contacts, q, fields, cells, normalize=False)
    assert not re.search(r"Exchange hashpartitioning\([^)]*_i#", plan(d))
    got = {(x.cp_id, x.qid): x for x in d.collect()}
    assert len(got) == d.count() == 1800 and all(got[3, n].gap == got[3, n].z and got[3, n].valid for n in {n for _, n in got})
    want = Q.query(q.crossJoin(fields.select("field_id")), fields, mode="trilinear", cells=cells).collect()
    assert 100 < sum(x.valid for x in want) < 1200
    for x in want:
        y = got[x.field_id, x.qid]
        assert x.valid == y.valid
        names = ["gap", "gx", "gy", "gz"]
        assert [y[n] for n in names] == (pytest.approx([x[n] for n in names], abs=1e-9) if x.valid else [None] * 4)
