import glob
import hashlib

import numpy as np

from facteng.llm import media
from facteng.llm.common import shared_folder


def test_media_are_stored_and_read_back(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    folder = shared_folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/facteng-media-*/*"))
    got = sorted((str(r.doc_id), r.media_bytes, r.media_sha256) for r in media.op8_progressive_jpeg(spark, str(tmp_path)).collect())
    (table,) = set(glob.glob(f"{folder}/facteng-media-*/*")) - before
    stored = [(r.doc_id, bytes(r.media)) for r in spark.read.parquet(table).collect()]
    assert got == sorted((str(i), len(m), hashlib.sha256(m).hexdigest()) for i, m in stored)


def test_features_come_from_stored_tensors(spark, docs, tmp_path, monkeypatch):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    plain = {}
    for r in media.decode(media.encode(docs)).collect():
        rgb = np.frombuffer(bytes(r.rgb), np.uint8).reshape(r.height, r.width, 3)
        plain.setdefault(str(r.doc_id), []).append((hashlib.sha256(bytes(r.rgb)).hexdigest(), media.feature_of(rgb)))
    save, stored = media.Scratch.save, []

    def watched(self, df, name="t", *args, **kw):
        out = save(self, df, name, *args, **kw)
        if name == "tensors":
            stored.extend((str(r.doc_id), hashlib.sha256(bytes(r.rgb)).hexdigest()) for r in out.collect())
        return out

    monkeypatch.setattr(media.Scratch, "save", watched)
    got = sorted((str(r.doc_id), r.feature) for r in media.op8_progressive_jpeg(spark, str(tmp_path)).collect())
    assert sorted(stored) == sorted((i, h) for i, x in plain.items() for h, _ in x)
    assert got == sorted((i, f) for i, x in plain.items() for _, f in x)
