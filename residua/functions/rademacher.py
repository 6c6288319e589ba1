"""Reproducible vectors of signs: HMAC-SHA256 of a block counter, bit by bit."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions.digests import canonical_json
from residua.functions.spreading import spread

# Signs in a digest, and the two pads of the keyed digest.
BLOCK = 256
INNER, OUTER = 0x36, 0x5C
SCHEME = "rademacher-hmac-sha256-v2"
LEAST_KEY = 16


@dataclass(frozen=True)
class Recipe:
    """How a family's right-hand sides are signed: a key and the fields of its domain."""

    key: bytes
    fields: dict

    @classmethod
    def of(cls, manifest: dict, older_names: dict[str, str] | None = None) -> Recipe:
        """The recipe of a manifest, whose faults are told all at once.

        A manifest names the scheme, the key in hexadecimal and the digest that the
        key was committed to by.  ``older_names`` maps releases to the names that
        their domain keeps.
        """
        stated = manifest.get("rhs") or {}
        digits = stated.get("public_key_hex") or ""
        key = bytes.fromhex(digits) if re.fullmatch("(?:[0-9a-fA-F]{2})+", digits) else b""
        committed = hashlib.sha256(key).hexdigest() == stated.get("key_id")
        faults = {
            "the scheme is not " + SCHEME: stated.get("scheme") != SCHEME,
            f"the key is not {LEAST_KEY} bytes or more in hexadecimal": len(key) < LEAST_KEY,
            "the key is not the committed one": not committed,
            "there is no draw": "draw_index" not in stated,
        }
        if any(faults.values()):
            raise ValueError("right-hand sides: " + "; ".join(what for what, bad in faults.items() if bad))
        release = manifest["release_id"]
        return cls(key, {"scheme": SCHEME, "release_id": (older_names or {}).get(release, release), "family": manifest["family"], "rhs_kind": "rademacher", "draw_index": stated["draw_index"]})

    def prefix(self, matrix_sha256: Column) -> Column:
        """``domain`` for a column of matrix digests: the canonical text around each."""
        before, after = domain(self.fields, "?").decode().split("?")
        return F.concat(F.lit(before), matrix_sha256, F.lit(after)).cast("binary")


def domain(fields: dict, matrix_sha256: str) -> bytes:
    """What is signed before the block counter."""
    return canonical_json({**fields, "matrix_sha256": matrix_sha256}) + b"\0"


def _pads(key: bytes) -> tuple[str, str]:
    own = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ INNER for b in own).hex(), bytes(b ^ OUTER for b in own).hex()


def _little_endian(block: Column) -> Column:
    return F.concat(*[F.lpad(F.hex(F.shiftright(block, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(8)])


def signs(sizes: DataFrame, key: bytes, prefix: bytes | Column) -> DataFrame:
    """Vectors of +1 and -1 for ``sizes(case_id, n)``: (case_id, i, x).

    ``prefix`` is signed before each block's counter; it may be a binary column
    of ``sizes``.  The digests are expressions, so no Python runs.
    """
    inner, outer = _pads(key)
    lead = F.hex(prefix) if isinstance(prefix, Column) else F.lit(prefix.hex())
    blocks = sizes.where("n > 0").select("case_id", "n", lead.alias("lead"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))).alias("block"))
    inside = F.unhex(F.concat(F.lit(inner), F.col("lead"), _little_endian(F.col("block"))))
    digest = F.unhex(F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(F.sha2(inside, 256))), 256))
    places = spread(blocks).select("case_id", "n", "block", F.hex(digest).alias("hex")).select("case_id", "n", "block", "hex", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1))).alias("k"))
    byte = F.conv(F.substr("hex", (F.floor(F.col("k") / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    bit = F.expr("shiftright(byte, k % 8) & 1")
    out = places.withColumn("byte", byte).withColumn("i", F.col("block") * BLOCK + F.col("k")).where("i < n")
    return out.select("case_id", "i", (2.0 * bit - 1.0).alias("x"))
