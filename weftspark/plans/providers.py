"""Realistic values from built-in vocabularies; ``register`` adds a provider."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.functions import rng
from weftspark.operators import lookups

FIRST = "Ada Ben Cleo Dan Eva Finn Gita Hugo Ines Jan Kim Lena Max Nora Otto Pia Quinn Ravi Sara Tom".split()
LAST = "Adler Brandt Castro Dubois Evans Fischer Garcia Hansen Ito Jones Keller Lopez Meyer Novak Olsen Petrov Rossi Silva Tanaka Weber".split()
CITIES = "Accra Berlin Cairo Delhi Dublin Hanoi Lagos Lima Lisbon Madrid Milan Nairobi Oslo Paris Prague Quito Riga Seoul Tokyo Vienna".split()
COUNTRIES = "Brazil Canada Chile Egypt France Germany Ghana India Italy Japan Kenya Mexico Norway Peru Poland Portugal Spain Vietnam".split()
COMPANIES = "Acme Borealis Cobalt Dynamo Ember Fjord Granite Harbor Indigo Juniper".split()
WORDS = "amber brook cedar delta ember field grove harbor island juniper kelp lagoon meadow north ocean prairie quarry ridge stone tide".split()

Maker = Callable[[dict, int, str, Column], Column]
_MAKERS: dict[str, Maker] = {}


def register(name: str, maker: Maker) -> None:
    """``maker(config, seed, stream, key)`` returns a Column for provider ``name``."""
    _MAKERS[name] = maker


def registered() -> list[str]:
    return sorted(_MAKERS)


def provide(ref: dict, seed: int, stream: str, key: Column) -> Column:
    """The Column of {"name": ..., "config": {...}}."""
    if ref["name"] not in _MAKERS:
        raise ValueError(f"no provider {ref['name']!r}; there are {registered()}")
    return _MAKERS[ref["name"]](ref.get("config", {}), seed, stream, key)


def _one_of(words: list[str]) -> Maker:
    def make(config: dict, seed: int, stream: str, key: Column) -> Column:
        return word(config.get("values", words), seed, stream, key)

    return make


def word(words: list[str], seed: int, stream: str, key: Column) -> Column:
    at = F.floor(rng.uniform01(seed, stream, key) * len(words)).cast("int")
    return F.element_at(F.array(*map(F.lit, words)), at + 1)


def _name(config: dict, seed: int, stream: str, key: Column) -> Column:
    return F.concat_ws(" ", word(FIRST, seed, f"{stream}/first", key), word(LAST, seed, f"{stream}/last", key))


def _email(config: dict, seed: int, stream: str, key: Column) -> Column:
    local = F.lower(F.concat_ws(".", word(FIRST, seed, f"{stream}/first", key), word(LAST, seed, f"{stream}/last", key)))
    return F.concat(local, F.lit("."), key.cast("string"), F.lit(f"@{config.get('domain', 'example.org')}"))


def _phone(config: dict, seed: int, stream: str, key: Column) -> Column:
    digits = F.floor(rng.uniform01(seed, stream, key) * 10_000_000).cast("string")
    return F.concat(F.lit(config.get("prefix", "+1-555-")), F.lpad(digits, 7, "0"))


def _address(config: dict, seed: int, stream: str, key: Column) -> Column:
    number = (1 + F.floor(rng.uniform01(seed, f"{stream}/n", key) * 999)).cast("string")
    return F.concat_ws(" ", number, F.initcap(word(WORDS, seed, f"{stream}/w", key)), F.lit("Street"))


def _sentence(config: dict, seed: int, stream: str, key: Column) -> Column:
    words = [word(WORDS, seed, f"{stream}/{i}", key) for i in range(config.get("words", 6))]
    return F.concat(F.initcap(words[0]), *[F.concat(F.lit(" "), w) for w in words[1:]], F.lit("."))


def _uuid(config: dict, seed: int, stream: str, key: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(stream), key.cast("string")))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


for _n, _m in {
    "person.name": _name, "person.first_name": _one_of(FIRST), "person.last_name": _one_of(LAST), "internet.email": _email,
    "phone.number": _phone, "geo.city": _one_of(CITIES), "geo.country": _one_of(COUNTRIES), "geo.address": _address,
    "company.name": _one_of(COMPANIES), "text.word": _one_of(WORDS), "text.sentence": _sentence, "id.uuid": _uuid, "lookup.values": _one_of(WORDS),
}.items():
    register(_n, _m)

LOOKUP = "lookup."


def lookup_source(name: str) -> tuple[str, str] | None:
    """(table, column) of a provider ``lookup.<table>.<column>``; None for others."""
    parts = name.removeprefix(LOOKUP).split(".") if name.startswith(LOOKUP) and name not in _MAKERS else []
    return (parts[0], parts[1]) if len(parts) == 2 else None


def lookup_columns(rows: DataFrame, key: str, asked: dict[str, dict], tables: dict[str, DataFrame], seed: int = 7, stream: str = "") -> DataFrame:
    """``rows`` with a column for each ``lookup.<table>.<column>`` provider, drawn from ``tables``.

    Configuration: ``weight``, a column of the table; ``order``, columns that tell its rows apart
    (all of them, if none); ``fallback``, the name of another provider. That one gives the values
    where the table or the column is not there; without it this is an error.
    """
    for column, ref in asked.items():
        name, source = lookup_source(ref["name"])
        config, place = ref.get("config", {}), f"{stream}.{column}" if stream else column
        if name not in tables or source not in tables[name].columns:
            if "fallback" not in config:
                raise ValueError(f"{place}: no {name}.{source} to look up")
            rows = rows.withColumn(column, provide({"name": config["fallback"], "config": config}, seed, place, F.col(key)))
            continue
        table = tables[name]
        held = table.select(*[F.col(c).alias(f"_t_{c}") for c in table.columns]).withColumn(column, F.col(f"_t_{source}"))
        order = [f"_t_{c}" for c in config.get("order", table.columns)]
        weight = f"_t_{config['weight']}" if config.get("weight") else None
        names = rows.columns if column in rows.columns else [*rows.columns, column]
        rows = lookups.draw_from(rows, key, held, [column], order, weight, seed, place).select(*names)
    return rows


# What a column's name says of its provider, first match first.
BY_NAME = (
    ("email", "internet.email"), ("phone", "phone.number"), ("first_name", "person.first_name"), ("last_name", "person.last_name"),
    ("city", "geo.city"), ("country", "geo.country"), ("address", "geo.address"), ("street", "geo.address"), ("company", "company.name"),
    ("uuid", "id.uuid"), ("description", "text.sentence"), ("comment", "text.sentence"), ("name", "person.name"),
)


def by_column_name(column: str) -> str | None:
    """The provider that a text column's name suggests."""
    return next((p for word_, p in BY_NAME if word_ in column.lower()), None)
