"""Reproducible draws and configuration identities as column expressions.

Random choices are hashes of (seed, indices): any engine with md5 repeats them, a retried
task repeats them, and no generator state has to travel with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(part) -> Column:
    if isinstance(part, Column):
        return part
    return F.col(part) if isinstance(part, str) else F.lit(part)


def hash32(*parts) -> Column:
    """First 32 bits of md5 over the '|'-joined parts. Strings name columns, other values are literals."""
    joined = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def draw_index(size, *parts) -> Column:
    """Uniform index in [0, size)."""
    return hash32(*parts) % _col(size)


def coin(*parts) -> Column:
    """Fair coin: low bit of the hash."""
    return hash32(*parts) % F.lit(2) == F.lit(1)


# Fields of a sampling configuration and the type each is coerced to (fixed values).
CONFIG_FIELDS = {
    "K": "int",
    "dataset": "string",
    "max_reasoning_length": "int",
    "max_tokens": "int",
    "model": "string",
    "num_prompts": "int",
    "prompt_template_version": "string",
    "seed": "int",
    "temperature": "double",
    "top_k": "int",
    "top_p": "double",
}
FINGERPRINT_HEX_CHARS = 16


def config_json(columns: dict[str, Column] | None = None) -> Column:
    """Canonical JSON of a sampling configuration: keys sorted, no blanks, nulls left out."""
    columns = columns or {}
    fields = [
        columns.get(name, F.col(name)).cast(kind).alias(name)
        for name, kind in sorted(CONFIG_FIELDS.items())
    ]
    return F.to_json(F.struct(*fields))


def config_fingerprint(columns: dict[str, Column] | None = None) -> Column:
    """Identity of a sampling configuration: leading hex characters of SHA-256 over its JSON."""
    return F.substring(F.sha2(config_json(columns), 256), 1, FINGERPRINT_HEX_CHARS)
