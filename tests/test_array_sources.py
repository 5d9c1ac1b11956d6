"""Array files, the feature cache and the sampler stream."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.sources import arrays, cache
from tandem.streaming import monitor, sampler


@pytest.fixture(scope="module")
def session(spark):
    spark.dataSource.register(arrays.ArrayFiles)
    spark.dataSource.register(sampler.ResourceSampler)
    return spark


def read(session, path, **options):
    return session.read.format("arrays").options(**options).load(path)


def test_ranges_of_every_kind(session, tmp_path):
    rng = np.random.default_rng(0)
    made = {
        "a": rng.normal(size=(1000, 3)).astype("float32"), "b": np.arange(700), "c": rng.integers(0, 2, (40, 2, 5)).astype(bool), "d": np.zeros((0, 4)),
        "e": np.arange(20, dtype=">i4").reshape(10, 2), "f": np.float64(3.5),
    }
    for name, table in made.items():
        np.save(tmp_path / f"{name}.npy", table)
    df = read(session, f"file://{tmp_path}", rangeBytes=1000)
    assert df.rdd.getNumPartitions() >= 18
    got = {}
    for r in df.collect():
        got.setdefault(os.path.basename(r.file)[0], {})[r.row] = r["values"]
    for name, table in made.items():
        want = np.atleast_1d(table).reshape(max(1, table.size // max(1, int(np.prod(table.shape[1:])))) if table.ndim else 1, -1) if table.size else table
        assert len(got.get(name, {})) == (len(table) if table.ndim else 1)
        for k, row in got.get(name, {}).items():
            assert np.array_equal(row, want[k].astype(float))


def test_archives_stored_and_compressed(session, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "BATCH", 64)
    x, y = np.arange(600.0).reshape(200, 3), np.arange(50)
    np.savez(tmp_path / "stored.npz", x=x, y=y)
    np.savez_compressed(tmp_path / "small.npz", x=x, y=y)
    for name, least in (("stored.npz", 5), ("small.npz", 2)):
        df = read(session, f"{tmp_path}/{name}", rangeBytes=960)
        assert df.rdd.getNumPartitions() >= least
        rows = {(r.member, r.row): r["values"] for r in df.collect()}
        assert len(rows) == 250 and all(rows["x", k] == x[k].tolist() for k in range(200)) and rows["y", 49] == [49.0]


def test_what_is_refused(session, tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "o.npy", np.array([{}], object), allow_pickle=True)
    (tmp_path / "x.npy").write_bytes(b"nothing")
    for name in "fox":
        with pytest.raises(Exception, match="not read|not an array"):
            read(session, f"{tmp_path}/{name}.npy").collect()
    np.save(tmp_path / "cut.npy", np.ones(1000))
    raw = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(raw[:-8])
    with pytest.raises(Exception, match="ends before"):
        read(session, f"{tmp_path}/cut.npy").collect()


def test_round_trip_append_and_overwrite(session, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    df = session.range(1000).select("id", F.array(F.col("id").cast("double"), F.col("id") / 2).alias("values"))
    df.repartitionByRange(7, "id").sortWithinPartitions("id").select("values").write.format("arrays").mode("append").save(path)
    got = read(session, path).collect()
    assert [r["values"] for r in sorted(got, key=lambda r: (r.file, r.row))] == [[float(i), i / 2] for i in range(1000)]
    df.limit(10).select("values").write.format("arrays").mode("append").save(path)
    assert read(session, path).count() == 1010
    df.where("id < 5").select("id").write.format("arrays").mode("overwrite").save(path)
    assert sorted(r["values"][0] for r in read(session, path).collect()) == [0, 1, 2, 3, 4]
    listed = json.load(open(f"{tmp_path}/out/{arrays.MANIFEST}"))["files"]
    assert sorted(os.path.basename(f) for f in glob.glob(f"{tmp_path}/out/*.npy")) == sorted(listed)
    ragged = session.createDataFrame([([1.0],), ([1.0, 2.0],)], "values array<double>").repartition(2)
    with pytest.raises(Exception, match="different lengths"):
        ragged.write.format("arrays").mode("append").save(path)
    assert read(session, path).count() == 5  # what failed is not read


def test_large_file_in_many_bounded_tasks(session, tmp_path):
    """256 MB, of which no task reads more than 8."""
    table = np.lib.format.open_memmap(tmp_path / "large.npy", "w+", "float32", (1 << 20, 64))
    table[::4096, 0] = np.arange(256)
    table.flush()
    df = read(session, f"{tmp_path}/large.npy", rangeBytes=8 << 20)
    assert df.rdd.getNumPartitions() == 32
    assert df.agg(F.count("*"), F.sum(F.col("values")[0])).first() == (1 << 20, float(sum(range(256))))


def test_cache_computes_what_is_new(session, tmp_path):
    path, asked = f"file://{tmp_path}/cache", []

    def compute(df):
        asked.append(sorted(r.text or "" for r in df.collect()))
        return df.select("_key", F.length("text").alias("size"))

    rows = session.createDataFrame([(1, "a"), (2, "bb"), (3, "bb"), (4, None)], "mol_id long, text string")
    want = {1: 1, 2: 2, 3: 2, 4: None}
    get = lambda df, **p: {r.mol_id: r["size"] for r in cache.cached(df, "mol_id", ["text"], compute, path, p).collect()}
    assert get(rows) == want and asked == [["", "a", "bb"]]
    assert get(rows) == want and len(asked) == 1
    changed = rows.union(session.createDataFrame([(5, "ccc"), (6, "")], rows.schema))
    assert get(changed) == {**want, 5: 3, 6: 0} and asked[1:] == [["", "ccc"]]
    assert get(rows, bits=8) == want and len(asked) == 3
    # a batch without its marker is not read
    for f in glob.glob(f"{tmp_path}/cache/batch-*/_SUCCESS"):
        os.remove(f)
    assert get(rows) == want and len(asked) == 4
    assert get(rows.limit(0)) == {}


def test_order_check(session):
    a = session.createDataFrame([(0, 7), (1, 8), (2, 9)], "place long, mol_id long")
    assert cache.check_order(a, a, "mol_id", "place").count() == 0
    b = session.createDataFrame([(0, 7), (1, 9), (2, 8), (3, 1), (0, 7)], "place long, mol_id long")
    assert {r.place for r in cache.check_order(a, b, "mol_id", "place").collect()} == {0, 1, 2, 3}


def test_sampler_restarts_without_loss_or_repeats(session, tmp_path):
    log, out, check = f"file://{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/check"
    seen = []
    for _ in range(3):
        stream = session.readStream.format("resources").option("log", log).option("seconds", 0).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = session.read.parquet(out)
        seen.append(rows.select("number").distinct().count())
        assert rows.count() == 4 * seen[-1] == rows.dropDuplicates(["number", "kind"]).count()
        assert rows.agg(F.max("number")).first()[0] == seen[-1] - 1
    assert seen[0] >= 1 and seen == sorted(set(seen))
    again = session.readStream.format("resources").option("log", log).option("seconds", 1e9).load()  # another stream, from the start
    monitor.run_available(monitor.window_peaks(again, "kind", "value"), f"{tmp_path}/peaks", f"{tmp_path}/check2")
    peaks = {r.kind: (r.samples, r.peak) for r in session.read.parquet(f"{tmp_path}/peaks").collect()}
    assert set(peaks) == {"load", "memory_mb", "rss_mb", "cpu_s"} and peaks["rss_mb"][0] >= seen[-1] and peaks["memory_mb"][1] > 0
