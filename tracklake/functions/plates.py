"""License plates: validity, and how they are shown in private."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A province's character, a letter without I and O, then five letters or digits.
PLATE_PATTERN = r"^[一-龥][A-HJ-NP-Z][A-HJ-NP-Z0-9]{5}\z"
#: New-energy plates have a sixth character after the letter; D or F stands first or last of the six.
NEW_ENERGY_PATTERN = r"^[一-龥][A-HJ-NP-Z](?:[DF][A-HJ-NP-Z0-9][0-9]{4}|[0-9]{5}[DF])\z"


def is_valid_plate(plate: Column, allow_new_energy: bool = False) -> Column:
    """Never null: a null plate is not valid."""
    text = plate.cast("string")
    valid = text.rlike(PLATE_PATTERN)
    if allow_new_energy:
        valid = valid | text.rlike(NEW_ENERGY_PATTERN)
    return F.coalesce(valid, F.lit(False))


def anonymized(value: Column) -> Column:
    """The first eight hexadecimal digits of the text's SHA-256; null stays null."""
    return F.substring(F.sha2(value.cast("string").cast("binary"), 256), 1, 8)


def masked(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit("***"))


def plate_state(private: bool, plates: list[str], shown: list[str], current: str, hashed: dict[str, str]) -> str:
    """Which plate a viewer shows after privacy is switched: the same vehicle if it is listed, else the first.

    ``shown`` are the labels of ``plates`` in the same order; ``hashed`` has the private label of each plate.
    """
    if private:
        return hashed[current] if current in plates else current if current in shown else shown[0]
    return plates[shown.index(current)] if current in shown else current if current in plates else plates[0]
