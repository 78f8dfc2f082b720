"""Lists, dictionaries and hyper-parameters stored as text in log and score files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.values import as_column, finite, is_tcn
from tidemark.schema import HP_ALIASES, HP_ALIASES_TCN


def parse_list(text: Column | str) -> Column:
    """List text to ``array<double>``; unreadable or missing text is an empty array, and an
    element that is no finite number is NULL."""
    parsed = F.from_json(F.trim(as_column(text)), "array<double>")
    return F.coalesce(F.transform(parsed, finite), F.array().cast("array<double>"))


def parse_dict(text: Column | str) -> Column:
    """Dictionary text to ``map<string,string>``.

    Accepts JSON, single-quoted text, and either of them inside one more pair of quotes with
    the inner quotes doubled.  Unreadable or missing text is an empty map.

    Numbers are put in quotes before parsing: the JSON reader would spell them anew
    (0.0001 as 1.0E-4), and the text of a value decides which config a row belongs to.
    """
    t = F.trim(as_column(text))
    bare = F.regexp_replace(t, r"""^(["'])(.*)\1$""", "$2")
    single = F.regexp_replace(bare, '""', '"')
    kind = "map<string,string>"
    quoted = lambda x: F.regexp_replace(
        x, r"""(["']\s*:\s*)(-?[0-9][0-9.eE+-]*)(?=\s*[,}])""", '$1"$2"')
    return F.coalesce(*[F.from_json(x, kind) for x in (quoted(bare), quoted(single), bare, single)],
                      F.map_from_arrays(F.array().cast("array<string>"),
                                        F.array().cast("array<string>")))


def hp_json(hp: Column | str) -> Column:
    """Canonical text of a hyper-parameter map: keys in order, values as stored."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(as_column(hp)))))


def _first_present(hp: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.try_element_at(hp, F.lit(n)) for n in names])


def hp_standardise(hp: Column | str, model: Column | str) -> dict[str, Column]:
    """One set of ``hp_*`` columns for all models, whatever names each model uses."""
    hp = as_column(hp)
    out = {}
    for name, aliases in HP_ALIASES.items():
        value = _first_present(hp, aliases)
        if name in HP_ALIASES_TCN:
            value = F.when(is_tcn(model), _first_present(hp, HP_ALIASES_TCN[name])) \
                     .otherwise(value)
        out[f"hp_{name}"] = value
    return out


def list_first(values: Column | str) -> Column:
    return F.try_element_at(as_column(values), F.lit(1))
