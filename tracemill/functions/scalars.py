"""Column expressions for parsing trace and sweep fields. All stay in codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENT_EPS = 1e-8


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den, and 0.0 where the denominator is zero or missing."""
    den = col_of(den).cast("double")
    return F.when(den != 0, col_of(num).cast("double") / den).otherwise(F.lit(0.0))


def percent_error(pred: str | Column, actual: str | Column) -> Column:
    pred, actual = col_of(pred), col_of(actual)
    return F.abs(pred - actual) / (F.abs(actual) + F.lit(PERCENT_EPS)) * F.lit(100.0)


HEX_DIGITS = "^0*[0-9a-fA-F]{1,16}$"


def hex_to_long(c: str | Column) -> Column:
    """Unsigned 64-bit hex text as a two's-complement BIGINT; blank is NULL, other text fails the job."""
    digits = F.regexp_replace(F.trim(col_of(c)), "^0[xX]", "")
    fault = F.raise_error(F.concat(F.lit("not a 64-bit hex number: "), col_of(c)))
    return F.when(digits.rlike(HEX_DIGITS), F.conv(digits, 16, -10).cast("bigint")).when(digits != "", fault)


def long_to_hex(c: str | Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(col_of(c))))


def parse_name_list(c: str | Column) -> Column:
    """`a; b;;c` -> [a, b, c]."""
    parts = F.transform(F.split(F.coalesce(col_of(c), F.lit("")), ";"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def parse_addr_list(c: str | Column) -> Column:
    """`0x10(8);0x20` -> [16, 32]; sizes dropped."""
    return F.transform(parse_name_list(c), lambda x: hex_to_long(F.split_part(x, F.lit("("), F.lit(1))))


def parse_mem_access_list(c: str | Column) -> Column:
    """`0x10(8);0x20` -> [{16, 8}, {32, 0}]."""
    return F.transform(
        parse_name_list(c),
        lambda x: F.struct(
            hex_to_long(F.split_part(x, F.lit("("), F.lit(1))).alias("addr"),
            F.coalesce(
                F.nullif(F.regexp_extract(x, r"\((\d+)\)", 1), F.lit("")).cast("int"), F.lit(0)
            ).alias("size"),
        ),
    )


def parse_bool(c: str | Column) -> Column:
    return F.coalesce(F.lower(F.trim(col_of(c).cast("string"))) == "true", F.lit(False))


def parse_branch_type(c: str | Column) -> Column:
    """Blank -> NULL (not a branch); anything outside the enum fails the job."""
    t = F.trim(col_of(c))
    known = t.isin("direct_unconditional", "direct_conditional", "indirect")
    return (
        F.when(col_of(c).isNull() | (t == ""), F.lit(None).cast("string"))
        .when(known, t)
        .otherwise(F.raise_error(F.concat(F.lit("unknown branch type: "), t)).cast("string"))
    )


def branch_taken(branch_type: str | Column, taken: str | Column) -> Column:
    """The taken flag, forced to false where the row is not a branch."""
    return F.when(col_of(branch_type).isNull(), F.lit(False)).otherwise(parse_bool(taken))


def parse_size(c: str | Column, unit: str = "kb") -> Column:
    """`256KiB`, `1MiB`, `1GiB` or a bare number -> KB or bytes (BIGINT).

    A bare number already is in the requested unit. Other text fails the job.
    """
    if unit not in ("kb", "bytes"):
        raise ValueError(f"unit must be kb or bytes, got {unit!r}")
    raw = col_of(c).cast("string")
    base = 1 if unit == "kb" else 1024

    def whole(factor: int) -> Column:
        return raw.substr(F.lit(1), F.length(raw) - 3).try_cast("bigint") * F.lit(factor)

    # The two usual spellings cost one suffix test and one cast.
    usual = F.when(raw.endswith("KiB"), whole(base)).when(raw.endswith("MiB"), whole(base * 1024))
    text = F.upper(F.trim(raw))
    digits = F.rtrim(text, F.lit("KMGIB "))
    suffix = F.trim(F.substring(text, F.length(digits) + 1, F.lit(8)))
    factor = (
        F.when(suffix == "", F.lit(1))
        .when(suffix.isin("K", "KB", "KI", "KIB"), F.lit(base))
        .when(suffix.isin("M", "MB", "MI", "MIB"), F.lit(base * 1024))
        .when(suffix.isin("G", "GB", "GI", "GIB"), F.lit(base * 1024 * 1024))
    )
    other = F.when(digits.rlike(r"^\d+(\.\d+)?$"), (digits.try_cast("double") * factor).cast("bigint"))
    bad = F.raise_error(F.concat(F.lit("unrecognised size: "), F.coalesce(text, F.lit("NULL")))).cast("bigint")
    return F.coalesce(usual, other, bad)


def encode_predictor(c: str | Column) -> Column:
    """local -> 0, tage -> 1, integers pass through, other text fails the job."""
    t = F.lower(F.trim(col_of(c).cast("string")))
    bad = F.raise_error(F.concat(F.lit("unknown branch predictor: "), F.coalesce(t, F.lit("NULL")))).cast("int")
    return F.when(t == "local", F.lit(0)).when(t == "tage", F.lit(1)).when(t.rlike(r"^-?\d+$"), t.cast("int")).otherwise(bad)


def hash_hex(keys: list[str | Column], seed: int | str) -> Column:
    """md5 of the key columns and the seed: the deterministic order of every sampler."""
    parts = [col_of(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hash_long(keys: list[str | Column], seed: int | str) -> Column:
    """A 52-bit non-negative integer from the hash."""
    return F.conv(F.substring(hash_hex(keys, seed), 1, 13), 16, 10).cast("bigint")


def hash_uniform(keys: list[str | Column], seed: int | str) -> Column:
    """A uniform double in [0, 1) from the hash (52 bits, exact in a double)."""
    return hash_long(keys, seed).cast("double") / F.lit(float(2**52))


def config_key(params: list[str]) -> Column:
    """12 hex digits that identify a configuration: names sorted, name and value joined."""
    parts = [F.concat(F.lit(p), F.col(p).cast("string")) for p in sorted(params)]
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, 12)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def require_columns(df: DataFrame, needed: list[str], what: str) -> DataFrame:
    """Schema check at plan time."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df


def must(condition: Column, message: str | Column, value: Column) -> Column:
    """`value`, or a failed job where the condition does not hold."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(text))
