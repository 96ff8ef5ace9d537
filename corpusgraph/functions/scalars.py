"""Column-level helpers.  Everything here returns a ``Column`` built from
built-in Spark SQL functions, so it stays inside whole-stage codegen (or at
least JVM-side for the higher-order array functions).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference treats these two function names as roots of the
# reachability closure and keys them by bare name instead of by position.
ROOT_FUNCTIONS = ("main", "init")

WORD_PATTERN = r"\p{L}+"

# Bijective base-26 letters are produced digit by digit; fourteen digits cover
# every BIGINT ordinal.
_PREFIX_DIGITS = 14


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: str | Column) -> Column:
    """Lower-cased letter runs of a text, in order (Unicode aware)."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORD_PATTERN), 0)


def lines(text: str | Column) -> Column:
    """Split on newline, keeping empty lines so positions stay stable."""
    return F.split(col(text), "\n")


def _geom(k: int) -> int:
    """1 + 26 + ... + 26**(k-1): first ordinal that needs k+1 letters minus 1."""
    return sum(26 ** j for j in range(k))


def ordinal_prefix(n: str | Column) -> Column:
    """1 -> a, 26 -> z, 27 -> aa, 28 -> ab, ... (bijective base 26).

    Digit k (from the right) exists when n >= s(k+1) and equals
    ((n - s(k)) div 26**k - 1) mod 26, with s(k) = 1 + 26 + ... + 26**(k-1).
    """
    n = col(n).cast("bigint")
    letters = []
    for k in reversed(range(_PREFIX_DIGITS)):
        s_k, s_k1, p = _geom(k), _geom(k + 1), 26 ** k
        digit = F.call_function("div", n - F.lit(s_k), F.lit(p))  # exact; floor for n >= s_k
        letter = F.when(n >= F.lit(s_k1), F.chr(F.lit(96) + ((digit - 1) % 26) + 1))
        letters.append(letter)
    return F.concat_ws("", *letters)


def receiver_type(recv: str | Column) -> Column:
    """Receiver type name without pointer star; NULL when absent or generic.

    A generic receiver such as ``Stack[T]`` is not a plain identifier, so its
    methods are keyed by bare name (as in the reference).
    """
    r = F.regexp_replace(F.trim(col(recv)), r"^\*\s*", "")
    return F.when(r.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), r)


def symbol_key(recv: str | Column, name: str | Column) -> Column:
    """``Recv.Name`` for a method, bare ``Name`` otherwise (concat_ws skips NULL)."""
    return F.concat_ws(".", receiver_type(recv), col(name))


def position_key(parts, name, reserved: Iterable[str] = ROOT_FUNCTIONS) -> Column:
    """Unique key per declaration occurrence (``path:line:col`` of ``parts``);
    reserved names keep their bare name."""
    pos = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.when(col(name).isin(list(reserved)), col(name)).otherwise(pos)


def base_name(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def parent_dir(path) -> Column:
    """Directory part of a slash path ('' when there is none)."""
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def before_first_dot(x) -> Column:
    return F.substring_index(col(x), ".", 1)


def after_first_dot(x) -> Column:
    return F.regexp_extract(col(x), r"^[^.]*[.](.*)$", 1)


def url_host(url) -> Column:
    return F.regexp_extract(col(url), r"https?://([^/?#]+)", 1)


def url_path(url) -> Column:
    """URL without scheme, query and fragment."""
    return F.regexp_extract(col(url), r"^(?:[a-z]+://)?([^?#]*)", 1)


def is_under(path, module) -> Column:
    """Path equals the module or lies below it (``module/...``), not a raw prefix."""
    return (col(path) == col(module)) | col(path).startswith(F.concat(col(module), F.lit("/")))


def ancestors(path) -> Column:
    """All proper ancestor directories of a slash path plus the path's directory
    chain: for ``a/b/c`` → [``a``, ``a/b``]."""
    parts = F.split(col(path), "/")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda k: F.array_join(F.slice(parts, 1, k), "/"),
    )
