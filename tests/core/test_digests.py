"""Digests of tables whose sums of keys pass 64 bits."""

import hashlib

from flowlens.operators import quality as dq


def test_fingerprint_beyond_64_bits(spark):
    n = 200_000
    got = dq.fingerprint(spark.range(n), ["id"]).first()
    total = sum(int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:12], 16) for i in range(n))
    assert total >= 1 << 63
    assert got["n_rows"] == n and got["id"] == (total + (1 << 63)) % (1 << 64) - (1 << 63)
    assert dq.fingerprint(spark.range(0), ["id"]).first()["id"] == 0
