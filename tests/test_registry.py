"""Shard files to a registry and back; what isn't as recorded is refused."""

import hashlib

from factloom.operators import registry


def test_round_trip(spark, tmp_path):
    place, home = str(tmp_path / "registry"), str(tmp_path / "home")
    (tmp_path / "shards").mkdir()
    rows = []
    for k in range(6):
        data = bytes([k]) * (3 << 20 if k == 0 else k)
        path = tmp_path / "shards" / f"s{k}"
        path.write_bytes(data)
        rows.append((f"s{k}", "v1" if k == 5 else "v2", hashlib.sha256(data).hexdigest(), str(path)))
    (tmp_path / "shards" / "s1").write_bytes(b"another")
    rows += [("s9", "v2", "0", str(tmp_path / "nowhere")), rows[2]]
    shards = spark.createDataFrame(rows, "id string, version string, checksum string, path string")
    told = lambda df: {r["id"]: r["action"] for r in df.collect()}
    assert told(registry.export(shards, "v2", place)) == {"s0": "copied", "s1": "checksum mismatch", "s2": "copied", "s3": "copied", "s4": "copied", "s5": "old version", "s9": "missing"}
    assert told(registry.export(shards, "v2", place))["s0"] == "there" and len(list((tmp_path / "registry/files").iterdir())) == 4
    names = {r["id"]: r["name"] for r in registry.listed(spark, place)[0].collect()}
    (tmp_path / "registry" / "files" / names["s3"]).write_bytes(b"damaged")
    wanted = spark.createDataFrame([(f"s{k}",) for k in (0, 2, 3, 3, 7)], "id string")
    assert told(registry.prefetch(wanted, place, home)) == {"s0": "copied", "s2": "copied", "s3": "extract (checksum mismatch)", "s7": "extract"}
    got = {r["id"]: r.asDict() for r in registry.listed(spark, home)[0].collect()}
    assert set(got) == {"s0", "s2"} and (tmp_path / "home" / "files" / got["s0"]["name"]).read_bytes() == bytes(3 << 20) and got["s2"]["size"] == 2
    assert told(registry.prefetch(wanted, place, home))["s0"] == "local"
    (tmp_path / "home" / "files" / "left by a lost task").write_bytes(b"x")
    assert registry.sweep(spark, home) == ["left by a lost task"] and set(registry.listed(spark, home)[0].toPandas()["id"]) == {"s0", "s2"}
