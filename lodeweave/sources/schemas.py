"""Schemas of the records, flat tables and inputs. Fixed names and orders."""

from __future__ import annotations

#: Records as XML: all leaves are arrays of strings, so that one bad number spoils nothing else.
RECORD_XML = (
    "id array<string>, name array<string>, value array<string>, category array<string>, "
    "tags array<struct<tag:array<string>>>, "
    "readings array<struct<reading:array<struct<timestamp:array<string>,sensor:array<string>,value:array<string>>>>>, "
    "meta array<struct<created:array<string>,updated:array<string>>>"
)
READING = "struct<timestamp:string,sensor:string,value:double>"
RECORD = f"id array<int>, name array<string>, value array<double>, category array<string>, tags array<string>, meta_created array<string>, meta_updated array<string>, readings array<{READING}>"
NESTED = (
    f"{RECORD}, "
    "measurements array<struct<type:string,data:string,method:array<struct<max:bigint,min:bigint,hash:double>>>>, "
    "locations array<struct<lat:double,lon:double,region:array<struct<h3_cell:string,country_code:string,region_ID:array<struct<region_hash:string,region_id:string>>>>>>, "
    "statistics array<struct<mean:bigint,mode:bigint,range:bigint,physics:array<struct<velocity:double,acceleration:double,mass:double>>,"
    "history:array<struct<previous:string,trend:string>>,business:array<struct<revenue:double,outlook:string>>>>"
)
CAR = (
    "color string, top_speed bigint, price double, engine array<struct<horsepower:bigint,mpg:bigint,engine_price:double>>, "
    "interior array<struct<interior_color:string,seat_material:string,heated_seats:boolean>>, exterior array<struct<paint_id:bigint,insured:boolean>>"
)

FLAT10 = {
    "id": "int", "name": "string", "value": "double", "category": "string", "tag": "string", "meta_created": "string", "meta_updated": "string",
    "reading_timestamp": "string", "reading_sensor": "string", "reading_value": "double",
}
_BRANCHES = {
    "measurement_type": "string", "measurement_data": "string", "method_max": "bigint", "method_min": "bigint", "method_hash": "double",
    "lat": "double", "lon": "double", "h3_cell": "string", "country_code": "string", "region_hash": "string", "region_id": "string",
    "stat_mean": "bigint", "stat_mode": "bigint", "stat_range": "bigint", "physics_velocity": "double", "physics_acceleration": "double", "physics_mass": "double",
    "history_previous": "string", "history_trend": "string", "business_revenue": "double", "business_outlook": "string",
}
FLAT31 = FLAT10 | _BRANCHES
FLAT_DATE31 = {k: FLAT10[k] for k in ("id", "name", "value", "category")} | {"year": "int", "month": "int", "day": "int", "h3_cell": "string"} | {k: v for k, v in FLAT31.items() if k.startswith("reading_")} | {k: v for k, v in _BRANCHES.items() if k != "h3_cell"}

PREDICTIONS = ("h3_cell", "timestamp", "label", "prediction")
HORIZONS = ("1hr", "6hr", "12hr")
WINDOWS = {"1h": 1, "6h": 6, "12h": 12, "24h": 24}


def conform(df, flat: dict[str, str]):
    """df with exactly the columns of `flat`, in order, cast; missing ones are null."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in flat.items()])
