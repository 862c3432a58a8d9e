"""Files in, files out."""

import json

import pytest

from citeloom.sources import files


def test_documents_and_objects(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("x\r\ny".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.bin").write_bytes(b"z")
    rows = {r["source_key"]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert rows["a.md"]["text"] == "x\ny" and rows["a.md"]["media_type"] == "text/markdown"
    assert rows["b.txt"]["problem"] == "INVALID_ENCODING" and rows["b.txt"]["text"] is None
    assert rows["c.bin"]["problem"] == "UNSUPPORTED_DOCUMENT_TYPE"
    stored = files.objects(spark, str(tmp_path))
    assert stored.count() == 3 and files.publication(stored).first()["bytes"] == 7
    sums = stored.selectExpr("object_key AS path", "sha256")
    assert files.checksum_breaches(sums, stored).count() == 0
    assert files.checksum_breaches(sums.withColumn("sha256", sums["path"]), stored).count() == 3


def test_inventory(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text("\n".join(json.dumps({"workspace_id": w, "object_key": "k", "created_at": "2024-01-01T00:00:00+00:00"}) for w in "ab"))
    assert files.inventory(spark, str(tmp_path / "good.jsonl"), "a").count() == 1
    (tmp_path / "bad.jsonl").write_text(json.dumps({"workspace_id": "a", "object_key": "k", "created_at": "2024-01-01T00:00:00"}))
    with pytest.raises(Exception, match="offset"):
        files.inventory(spark, str(tmp_path / "bad.jsonl")).collect()


def test_report_is_written_once(spark, tmp_path):
    files.write_once(spark.range(1), str(tmp_path / "r"))
    with pytest.raises(Exception, match="already exists"):
        files.write_once(spark.range(1), str(tmp_path / "r"))
    files.append(spark.range(2), str(tmp_path / "t"))
    files.append(spark.range(2), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
