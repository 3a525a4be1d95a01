"""Name normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

# Ordered replacements in site names.
SITE_REPLACEMENTS = {" ": "-", ".": "_"}

# Ordered replacements in weather-station names.
STATION_REPLACEMENTS = {
    " ": "-",
    "Marseille-Marignane": "Marignane",
    "Le-Luc": "Le Luc",
    "St-": "Saint-",
    "Bordeaux-Merignac": "Bordeaux",
    "Caen-Carpiquet": "Caen",
    "Clermont-Fd": "Clermont-Ferrand",
    "Dijon-Longvic": "Dijon",
    "Lille-Lesquin": "Lille",
    "Lyon-Saint-Exupery": "Lyon-Satolas",
    "Nancy-Ochey": "Nancy-Essey",
    "Nantes-Bouguenais": "Nantes",
    "Rennes-Saint-Jacques": "Rennes",
    "Strasbourg-Entzheim": "Strasbourg",
    "Tarbes-Ossun": "Tarbes-Ossuns",
    "Dumont-D'Urville": "Trappes",
    "Troyes-Barberey": "Troyes",
}

# Ordered replacements in administrative region names.
REGION_REPLACEMENTS = {"  ": " ", "-De-": "-de-", " De ": " de ", " D'": " d'"}


def _replace_all(column: Column, replacements: Mapping[str, str]) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), replacements.items(), column)


def strip_accents(column: Column) -> Column:
    out = F.translate(column, ACCENTED, PLAIN)
    for ligature, letters in (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss")):
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return out


def title_case(column: Column) -> Column:
    """Upper-case a letter after any non-letter, lower-case it after a letter."""
    words = F.split(column, r"(?<=[^\p{L}])")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def site_name(column: Column) -> Column:
    return _replace_all(F.upper(column), SITE_REPLACEMENTS)


def station_name(column: Column) -> Column:
    return _replace_all(title_case(column), STATION_REPLACEMENTS)


def region_name(column: Column) -> Column:
    return _replace_all(title_case(column), REGION_REPLACEMENTS)


def grid_region_name(column: Column) -> Column:
    return F.upper(F.replace(column, F.lit("USE "), F.lit("")))


def input_name(quantity: Column, transformation: Column, parameter: Column, location: Column) -> Column:
    """Feature name: parts joined by ``_``, runs of ``_`` collapsed, ends trimmed."""
    joined = F.concat_ws(
        "_",
        quantity,
        F.substring(F.coalesce(transformation, F.lit("")), 1, 3),
        F.replace(F.coalesce(parameter, F.lit("")), F.lit("-"), F.lit("m")),
        F.replace(F.coalesce(location, F.lit("")), F.lit("-"), F.lit("_")),
    )
    return F.regexp_replace(F.regexp_replace(joined, "_+", "_"), "^_|_$", "")
