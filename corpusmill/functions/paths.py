"""Spellings of one path."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DATA_ROOT = "/data/train_data"


def same_file(path: Column, data_root: str = DATA_ROOT) -> Column:
    """The path below the data root in lower case; equal for all spellings of one file.

    Blanks around it, back slashes, doubled slashes, ``.`` steps, a leading ``./`` and the data
    root are set aside. Null and blank paths give null.
    """
    p = F.lower(F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), r"[\\/]+(?:\.[\\/]+)*", "/"))
    root = re.escape(data_root.strip("/").lower())
    p = F.regexp_replace(p, rf"^(?:\./)?(?:/?{root}/)?(?:\./|/)*", "")
    return F.when(p != "", p)
