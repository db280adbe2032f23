"""Small expression-building helpers shared by all column functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def until(close: str) -> str:
    """Pattern for everything up to the first ``close``, which must start with ``<``.

    Same text as a lazy any-character scan, but it hops from one ``<`` to the next
    instead of testing every character, and never backtracks.
    """
    return rf"(?:[^<]++|<(?!{close[1:]}))*+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Nested regex chains mention their input more than once; without a binding
    the expression tree doubles at every step of the chain.
    """
    return F.transform(F.array(value), body).getItem(0)


def regexp_map(
    text: Column,
    pattern: str,
    replace: Callable[..., Column],
    groups: Sequence[int] = (1,),
) -> Column:
    """Replace every match by ``replace(*captures)``, any expression over one or two captures.

    ``regexp_replace`` can only paste captures; here the replacement may be an
    entity lookup, a trim or a nested conversion. The text is cut at the matches
    and glued back together with the mapped captures in between. ``text`` is
    mentioned more than once: bind it with ``let`` when it is costly.
    """
    captures = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    mapped = F.transform(captures[0], replace) if len(captures) == 1 else F.zip_with(*captures, replace)
    glued = F.zip_with(
        F.split(text, pattern, -1), mapped, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))
    )
    return F.when(text.rlike(pattern), F.array_join(glued, "")).otherwise(text)


def string_map(entries: dict[str, str]) -> Column:
    """A literal MAP<STRING,STRING>, folded to one constant before execution."""
    packed = "\n".join(f"{k}\t{v}" for k, v in entries.items())
    return F.str_to_map(F.lit(packed), F.lit("\n"), F.lit("\t"))


def lookup(entries: dict[str, str], key: Column) -> Column:
    """Value of a small literal map, NULL when the key is absent."""
    return F.try_element_at(string_map(entries), key)
