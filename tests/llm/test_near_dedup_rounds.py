import numpy as np

from laketide.llm import near_dedup


def mosaics(spark, n=60):
    """Texts of the same paragraphs, half of them shared pairwise: all meet in buckets, none link."""
    rng = np.random.default_rng(5)
    paragraphs = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(24)]
    rows = [(i, " ".join(paragraphs[j] for j in sorted(rng.choice(24, 14, replace=False)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_rounds_end_when_they_close_nothing(spark, monkeypatch):
    """Star rounds that leave the pairs open are not repeated; before, all of ``STAR_ROUNDS`` ran."""
    turns, plain = [], near_dedup.similar
    monkeypatch.setattr(near_dedup, "PAIRS_PER_NODE", 0)
    monkeypatch.setattr(near_dedup, "similar", lambda *a: turns.append(1) or plain(*a))
    got = near_dedup.groups(mosaics(spark)).collect()
    assert len(got) == 60 and all(r.kept for r in got)
    assert 1 <= len(turns) <= 3


def test_planes_count_like_bytes(spark):
    """Sketches as planes of bits pass the comparison exactly when enough bytes agree, also where 64 does not divide their number."""
    rng = np.random.default_rng(2)
    for t in (200, 64, 15):
        a = rng.integers(0, 256, (40, t), dtype=np.uint8)
        b = np.where(rng.random((40, t)) < np.linspace(0.3, 1, 40)[:, None], a, rng.integers(0, 256, (40, t), dtype=np.uint8))
        rows = [(i, x, y) for i, (x, y) in enumerate(zip(near_dedup._planes(a).tolist(), near_dedup._planes(b).tolist(), strict=True))]
        df = spark.createDataFrame(rows, "i long, digits array<long>, bdigits array<long>")
        least = int(t * 0.8 - 5.5 * (t * 0.8 * 0.2) ** 0.5)
        want = {i for i, n in enumerate((a == b).sum(axis=1).tolist()) if n >= least}
        assert {r.i for r in df.where(near_dedup._alike(t, 80)).collect()} == want and 0 < len(want)
