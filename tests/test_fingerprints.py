import hashlib
import json
import os

from pyspark.sql import functions as F

from lodestrata.operators import fingerprints as fp
from lodestrata.sources import readers


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def by_hand(root, chunk):
    leaves = {}
    for d, _, names in os.walk(root):
        for n in names:
            path = os.path.relpath(os.path.join(d, n), root)
            data = open(os.path.join(d, n), "rb").read()
            whole = sha("".join(sha(data[i : i + chunk]) for i in range(0, max(len(data), 1), chunk)))
            leaves[path] = sha(f"{len(path.encode()):010d}:{path}:{whole}")
    levels = {}
    for path in sorted(leaves):
        levels.setdefault(hashlib.md5(path.encode()).hexdigest()[:4], []).append(leaves[path])
    top = {}
    for p in sorted(levels):
        top.setdefault(p[:2], []).append(sha("".join(levels[p])))
    return sha("".join(sha("".join(top[q])) for q in sorted(top)))


def fingerprint(spark, root):
    found = fp.files(spark, str(root))
    return fp.tree(found.select("path", fp.content_hash(F.col("content")).alias("hash"))).first()


def test_tree_equals_hashlib_and_sees_every_change(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fp, "CHUNK", 10)
    root = tmp_path / "tree"
    for path, data in {"a.txt": b"0123456789" * 3, "b/c.bin": bytes(range(200)), "b/é d+e%.txt": "ü".encode() * 40, "z/z/z": b"0123456789x"}.items():
        os.makedirs((root / path).parent, exist_ok=True)
        (root / path).write_bytes(data)
    seen = {"first": fingerprint(spark, root)["fingerprint"]}
    assert seen["first"] == by_hand(root, 10) and fingerprint(spark, root)["files"] == 4
    (root / "a.txt").write_bytes(b"0123456789" * 2 + b"012345678x")
    seen["byte"] = fingerprint(spark, root)["fingerprint"]
    (root / "a.txt").rename(root / "a2.txt")
    seen["renamed"] = fingerprint(spark, root)["fingerprint"]
    (root / "a2.txt").rename(root / "b/a2.txt")
    seen["moved"] = fingerprint(spark, root)["fingerprint"]
    assert len(set(seen.values())) == 4 and seen["moved"] == by_hand(root, 10)
    assert fingerprint(spark, root)["fingerprint"] == seen["moved"]


def test_tree_of_nothing_and_of_a_listing(spark, tmp_path):
    none = spark.createDataFrame([], "path string, hash string")
    assert tuple(fp.tree(none).first()) == (0, sha(""))
    (tmp_path / "x").write_text("1")
    one = readers.tree_fingerprint(readers.listing(spark, str(tmp_path))).first()["fingerprint"]
    (tmp_path / "x").write_text("2")
    assert one != readers.tree_fingerprint(readers.listing(spark, str(tmp_path))).first()["fingerprint"]


PACK = {"z": [3, {"q": 'é"\n', "p": True}], "a": {"b": None, "a": 1.5}, "metadata": {"llm_adapter": {"admitted": 1}, "k": 7}}


def test_canonical_json_equals_sorted_dumps(spark):
    plain = json.dumps(PACK)
    spaced = json.dumps(dict(reversed(PACK.items())), indent=3, ensure_ascii=False)
    other = json.dumps(PACK | {"metadata": {"llm_adapter": {"admitted": 2, "why": "x"}, "k": 7}})
    bare = json.dumps(PACK | {"metadata": {"k": 7}})
    rows = {"plain": plain, "spaced": spaced, "other": other, "bare": bare, "no object": '{"metadata": 5, "a": 1}', "none": '{"a": 1}', "list": "[2, 1]", "bad": "{", "null": None}
    df = spark.createDataFrame(list(rows.items()), "name string, t string")
    got = {r["name"]: (r["c"], r["h"]) for r in df.select("name", fp.canonical(F.col("t")).alias("c"), fp.canonical_hash(F.col("t"), "metadata.llm_adapter").alias("h")).collect()}
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got["plain"][0] == got["spaced"][0] == dump(PACK) != got["other"][0]
    assert got["plain"][1] == got["spaced"][1] == got["other"][1] == got["bare"][1] == sha(dump(PACK | {"metadata": {"k": 7}}))
    assert got["no object"][1] == sha('{"a":1,"metadata":5}') and got["none"][1] == sha('{"a":1}') and got["list"][1] == sha("[2,1]")
    assert got["bad"] == got["null"] == (None, None)


def test_run_signature(spark):
    df = spark.createDataFrame([(1, 0.5, None), (1, 0.5, "dev"), (2, 0.5, None)], "k int, w double, split string")
    sign = lambda *fields: fp.run_signature(F.struct(*fields), F.lit("s"), F.lit("m"), F.col("split")).alias("x")
    one, two = (df.select(sign(*order)).collect() for order in (("k", "w"), ("w", "k")))
    assert one == two and len({r["x"] for r in one}) == 3
    assert one[0]["x"] == sha('{"config":{"k":1,"w":0.5},"manifest_sha256":"m","source_sha256":"s","split":"all"}')
