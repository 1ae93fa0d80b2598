"""Column functions: logits, byte decoding, fingerprints, path keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_pred(score: Column, cut: float = 0.0) -> Column:
    return score > cut


def pred_to_score(pred: Column) -> Column:
    return F.when(pred, 1.0).otherwise(-1.0)


def logit(p: Column, eps: float = 1e-6) -> Column:
    """Of a probability clipped to [eps, 1 - eps]."""
    return -F.log(1 / F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)) - 1)


def logit_unclipped(p: Column, eps: float = 1e-8) -> Column:
    """Of a probability with ``eps`` added, not clipped; null where there is none."""
    ratio = 1 / (p + eps) - 1
    return F.when(ratio > 0, -F.log(ratio))


def little_endian(values: Column) -> Column:
    """The number that an array of byte values writes, lowest first."""
    return F.aggregate(F.reverse(values), F.lit(0).cast("decimal(38,0)"), lambda acc, b: (acc * 256 + b).cast("decimal(38,0)"))


def sign_extend(value: Column, size: int) -> Column:
    """A number of ``size`` bytes read as two's complement."""
    return F.when(value >= 2 ** (8 * size - 1), value - 2 ** (8 * size)).otherwise(value)


def fingerprint(content: Column) -> Column:
    """md5 of the first and last 1024 bytes and the size; null below 1024 bytes."""
    n = F.octet_length(content)
    size = F.encode(n.cast("string"), "UTF-8")
    return F.when(n >= 1024, F.md5(F.concat(F.substring(content, 1, 1024), F.substring(content, n - 1023, F.lit(1024)), size)))


def little_pad(values: Column, size: int, pad: Column) -> Column:
    """An array cut or padded to ``size``."""
    return F.slice(F.concat(values, F.array_repeat(pad, size)), 1, size)


def base_addr(fmt: Column, section_va: Column, image_base: Column) -> Column:
    """Where the code section lies: for PE its relative address plus the image base."""
    return F.when(fmt == "PE", section_va + image_base).otherwise(section_va)


def parent_dir(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def strip_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def relative_to(path: Column, root: str) -> Column:
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(path)


def option_keys(path: Column, grammar: str) -> Column:
    """(compiler, opt, arch) that a path names, by one of the grammars rw, sok, quarks, llvm; null for other shapes.

    rw: part 1 is the compiler, part 2 the level, 32 in the compiler means x86. sok: in the part before the last, or for
    openssl in the last, two tokens are x64 and three x32. quarks: obfuscator, its mode and the level at the end of the
    name. llvm: the first two parts; for SPEC the first and the year.
    """
    p = F.split(path, "/")
    n = F.size(p)

    def at(k: int) -> Column:
        return F.get(p, F.lit(k) if k >= 0 else n + k)

    none = F.lit(None).cast("string")

    def keys(a: Column, b: Column, c: Column) -> Column:
        return F.struct(a.alias("compiler"), b.alias("opt"), c.alias("arch"))

    empty = F.lit(None).cast("struct<compiler:string,opt:string,arch:string>")
    if grammar == "rw":
        return F.when(n >= 3, keys(at(1), at(2), F.when(at(1).contains("32"), "x86").otherwise("x64"))).otherwise(empty)
    if grammar == "sok":
        last, before = F.split(at(-1), "_"), F.split(at(-2), "_")
        level = F.substring_index(F.element_at(last, -1), ".", 1)
        openssl = F.when(F.size(last) == 2, keys(F.lit("gcc"), level, F.lit("x64"))).when(F.size(last) == 3, keys(F.lit("gcc"), level, F.lit("x32"))).otherwise(empty)
        other = (
            F.when(F.size(before) == 2, keys(F.get(before, F.lit(0)), F.get(before, F.lit(1)), F.lit("x64")))
            .when(F.size(before) == 3, keys(F.get(before, F.lit(0)), F.get(before, F.lit(2)), F.lit("x32")))
            .otherwise(empty)
        )
        return F.when(n < 2, empty).when(at(1).contains("openssl"), openssl).otherwise(other)
    if grammar == "quarks":
        level = F.element_at(F.split(F.substring_index(at(-1), ".", 1), "_"), -1)
        return F.when(n < 4, keys(none, none, level)).otherwise(keys(at(2), at(3), level))
    if grammar == "llvm":
        year = F.when(at(3).contains("2017"), "2017").when(at(3).contains("2006"), "2006").otherwise(at(3))
        return F.when(n < 2, empty).when(~path.contains("SPEC"), keys(at(0), at(1), none)).otherwise(keys(at(0), year, none))
    raise ValueError(f"no such grammar: {grammar}")


def utc_time(seconds: Column) -> Column:
    """Seconds since the epoch as a UTC date and time, whatever the session's zone."""
    return F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss")
