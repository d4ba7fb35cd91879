"""Column names and types of the input tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File header -> name in this library, and the type of each column.
BUILDING_HEADERS = {
    "BUILD_ID": "build_id",
    "year_built": "year_built",
    "Est GFA sqmeters": "gfa",
    "SQMETERS": "sqmeters",
    "HEIGHT": "height",
    "PRED_HEIGHT": "pred_height",
    "OCC_CLS": "occ_cls",
    "PRIM_OCC": "prim_occ",
    "OCC_DICT": "occ_dict",
    "MIX_SC": "mix_sc",
    "material_type": "material_type",
    "foundation_type": "foundation_type",
    "drainagecl": "drainagecl",
    "flodfreqcl": "flodfreqcl",
    "eng_property": "eng_property",
    "wtdepannmin": "wtdepannmin",
    "compname": "compname",
    "mukey": "mukey",
    "LONGITUDE": "longitude",
    "LATITUDE": "latitude",
}
CLF_HEADERS = {
    "Est GFA sqmeters": "gfa",
    "mass_total": "mass_total",
    "gwp_a_to_c": "gwp_a_to_c",
    "OCC_CLS": "occ_cls",
    "material_type": "material_type",
    "str_sys_summary": "str_sys_summary",
    "general_fnd_type": "general_fnd_type",
}
SHORELINE_COLUMNS = {
    "LATITUDE": T.DoubleType(),
    "LONGITUDE": T.DoubleType(),
    "OCC_CLS": T.StringType(),
    "material_type": T.StringType(),
    "foundation_type": T.StringType(),
    "year_built": T.DoubleType(),
}
DOUBLES = {
    "year_built", "gfa", "sqmeters", "pred_height", "eng_property", "wtdepannmin", "longitude", "latitude",
    "mass_total", "gwp_a_to_c",
}
# Id columns in order of preference.
ID_COLUMNS = ("BUILD_ID", "UUID", "OBJECTID", "OGC_FID", "fid", "id")


def type_of(name: str) -> T.DataType:
    if name == "build_id":
        return T.LongType()
    return T.DoubleType() if name in DOUBLES else T.StringType()


BUILDING_TYPES = {name: type_of(name) for name in BUILDING_HEADERS.values()}


def ensure_columns(df: DataFrame, required: Mapping[str, T.DataType]) -> DataFrame:
    """Add each missing column as a typed null."""
    missing = {c: F.lit(None).cast(t) for c, t in required.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def id_column(columns: list[str]) -> str:
    """The preferred id column among ``columns``.

    A row position is no stable id on a partitioned table, so one of them must exist.
    """
    for name in ID_COLUMNS:
        if name in columns:
            return name
    raise ValueError(f"no id column; expected one of {', '.join(ID_COLUMNS)}")
