"""Queries on frames, embedded pictures and backgrounds of written files."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window, functions as F

from docframe.decode import container, frames as D
from docframe.operators import sequences as S
from docframe.plans.formats import _key, _mapped, _suppliers
from docframe.plans.registry import query

_FRAMES = "path string, z int, id int, kind int, item int, x int, y int, w long, h long, fixed boolean, on_text boolean, wrap boolean, wrap_blank boolean"


def _file(r):
    """nation % 4 + 1 frames, every second one a picture; each picture's object once or twice in the map."""
    n, key = r["nation"] % 4 + 1, r["key"]
    rows = [{"id": 10 + k, "kind": 1 if k % 2 == 0 else 2, "item": k, "x": key - 50, "y": -k, "w": 100 * k + key, "h": 70, "fixed": k == 1, "wrap": k < 2, "wrap_blank": k == 0} for k in range(n)]
    shown = [(10 + k, 20 + k) for k in range(0, n, 2)] + [(10, 99)]
    pictures = {f"/EmbedItems/Embedding {20 + k}/Contents": b"head" * 3 + len(_picture(key, k)).to_bytes(4, "little") + _picture(key, k) + b"tail" for k in range(0, n, 2)}
    return container.write_container({"/Frame": D.frames_bytes(rows), "/EmbedItems/EmbeddingInfo": D.embeddings_bytes(shown), **pictures})


def _picture(key: int, k: int) -> bytes:
    return b"GIF89a" + str(key * 10 + k).encode().rjust(20, b".")


def _written(spark, sf_dir):
    return _mapped(_suppliers(spark, sf_dir), "path string, content binary", lambda r: [(r["path"], _file(r))])


def _frames(written):
    def rows(r):
        c = container.open_container(r["content"])
        return [(r["path"], z, *(f[n] for n in ("id", "kind", "item", "x", "y", "w", "h", "fixed", "on_text", "wrap", "wrap_blank"))) for z, f in enumerate(D.frames(c.read(c.find("/Frame"))), 1)]

    return _mapped(written, _FRAMES, rows)


def _objects(written):
    def rows(r):
        c = container.open_container(r["content"])
        return [(r["path"], k, *e) for k, e in enumerate(D.embeddings(c.read(c.find("/EmbedItems/EmbeddingInfo"))))]

    return _mapped(written, "path string, place int, id int, number int", rows)


def _pictures(written):
    def rows(r):
        c = container.open_container(r["content"])
        out = []
        for e in c.entries:
            if e.kind == "stream" and e.path.startswith("/EmbedItems/Embedding ") and (found := D.picture(c.read(e))):
                out.append((r["path"], int(e.path.split("/")[2].split(" ")[1]), found[0], len(found[1]), hashlib.md5(found[1]).hexdigest()))
        return out

    return _mapped(written, "path string, number int, mime string, n_bytes long, digest string", rows)


@query("""
SELECT s_suppkey, CAST(k + 1 AS INTEGER) AS z, CAST(10 + k AS INTEGER) AS id, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS kind, CAST(s_suppkey - 50 AS BIGINT) AS x, 100 * k + s_suppkey AS w, k = 1 AS fixed, k < 2 AS wrap, k = 0 AS wrap_blank FROM supplier, range(4) r(k) WHERE k <= s_nationkey % 4
""")
def d34_frames(spark, sf_dir):
    return _frames(_written(spark, sf_dir)).select(_key().alias("s_suppkey"), "z", "id", "kind", F.col("x").cast("bigint").alias("x"), "w", "fixed", "wrap", "wrap_blank")


@query("""
SELECT s_suppkey, CAST(10 + k AS INTEGER) AS id, 'image/gif' AS mime, md5(concat('GIF89a', lpad(CAST(s_suppkey * 10 + k AS VARCHAR), 20, '.'))) AS digest FROM supplier, range(4) r(k) WHERE k <= s_nationkey % 4 AND k % 2 = 0 AND (k / 2 + 1) * 26 <= 60
""")
def d35_pictures(spark, sf_dir):
    """Picture frames with the object that the map names first for them, and its picture, up to a total size by file."""
    written = _written(spark, sf_dir)
    first = _objects(written).withColumn("_n", F.row_number().over(Window.partitionBy("path", "id").orderBy("place"))).where("_n = 1").drop("_n", "place")
    shown = _frames(written).where("kind = 1").select("path", "z", "id").join(first, ["path", "id"]).join(_pictures(written), ["path", "number"])
    kept = S.within_budget(shown, ["path"], ["z"], F.col("n_bytes"), F.lit(60))
    return kept.select(_key().alias("s_suppkey"), "id", "mime", "digest")


@query("""
SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN concat('#', printf('%02x', s_nationkey), '10', printf('%02x', s_suppkey % 256)) END AS color, CASE WHEN s_nationkey % 2 = 1 THEN 'image/png' END AS mime FROM supplier
""")
def d36_backgrounds(spark, sf_dir):
    """The colour or the picture behind a page."""

    def rows(r):
        given = {"color": (r["nation"], 16, r["key"] % 256)} if r["nation"] % 2 == 0 else {"file": b"\x89PNG..."}
        found = D.background(D.background_bytes(**given, path="C:\\x" if r["key"] % 3 else ""))
        return [(r["key"], found.get("color"), found.get("mime"))]

    return _mapped(_suppliers(spark, sf_dir), "s_suppkey long, color string, mime string", rows)
