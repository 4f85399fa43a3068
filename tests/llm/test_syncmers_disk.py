"""What operator 4 keeps on disk."""

import random

from loomline.llm import common, syncmers


def test_kept_fingerprints_are_packed(spark, tmp_path, monkeypatch):
    """Hexadecimal digits take about half a byte each."""
    rng = random.Random(16)
    rows = [(k, " ".join(f"{rng.randrange(10**6)}" for _ in range(40))) for k in range(3000)]
    monkeypatch.setattr(common, "_open", [str(tmp_path)])
    got = syncmers.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()
    digits = sum(len(r.fingerprint) + len(r.edited_fingerprint) + len(r.edited_sha256) for r in got)
    assert len(got) == len(rows)
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 0.7 * digits
