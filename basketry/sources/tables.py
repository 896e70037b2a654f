"""Raw input tables (S1, S2, S5): explicit schemas, CSV or Parquet, no inference."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File names of the public marketplace dataset.
RAW_FILES = {
    "customers": "olist_customers_dataset.csv",
    "orders": "olist_orders_dataset.csv",
    "products": "olist_products_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "payments": "olist_order_payments_dataset.csv",
    "reviews": "olist_order_reviews_dataset.csv",
    "translation": "product_category_name_translation.csv",
    "sellers": "olist_sellers_dataset.csv",
    "geolocation": "olist_geolocation_dataset.csv",
}
REQUIRED = ("customers", "orders", "products", "order_items", "payments", "reviews",
            "translation")

# Tokens pandas' CSV reader turns into a missing value by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

S, D, I = T.StringType(), T.DoubleType(), T.IntegerType()


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SCHEMAS = {
    "customers": _schema(("customer_id", S), ("customer_unique_id", S),
                         ("customer_zip_code_prefix", S), ("customer_city", S),
                         ("customer_state", S)),
    "orders": _schema(("order_id", S), ("customer_id", S), ("order_status", S),
                      ("order_purchase_timestamp", S), ("order_approved_at", S),
                      ("order_delivered_carrier_date", S),
                      ("order_delivered_customer_date", S),
                      ("order_estimated_delivery_date", S)),
    "order_items": _schema(("order_id", S), ("order_item_id", I), ("product_id", S),
                           ("seller_id", S), ("shipping_limit_date", S), ("price", D),
                           ("freight_value", D)),
    "payments": _schema(("order_id", S), ("payment_sequential", I), ("payment_type", S),
                        ("payment_installments", I), ("payment_value", D)),
    "reviews": _schema(("review_id", S), ("order_id", S), ("review_score", D),
                       ("review_comment_title", S), ("review_comment_message", S),
                       ("review_creation_date", S), ("review_answer_timestamp", S)),
    "products": _schema(("product_id", S), ("product_category_name", S),
                        ("product_name_lenght", D), ("product_description_lenght", D),
                        ("product_photos_qty", D), ("product_weight_g", D),
                        ("product_length_cm", D), ("product_height_cm", D),
                        ("product_width_cm", D)),
    "translation": _schema(("product_category_name", S),
                           ("product_category_name_english", S)),
    "sellers": _schema(("seller_id", S), ("seller_zip_code_prefix", S),
                       ("seller_city", S), ("seller_state", S)),
    "geolocation": _schema(("geolocation_zip_code_prefix", S), ("geolocation_lat", D),
                           ("geolocation_lng", D), ("geolocation_city", S),
                           ("geolocation_state", S)),
}

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
TIMESTAMP_COLUMNS = {
    "orders": ["order_purchase_timestamp", "order_approved_at",
               "order_delivered_carrier_date", "order_delivered_customer_date",
               "order_estimated_delivery_date"],
    "reviews": ["review_creation_date", "review_answer_timestamp"],
    "order_items": ["shipping_limit_date"],
}


@dataclass
class RawTables:
    customers: DataFrame
    orders: DataFrame
    products: DataFrame
    order_items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    translation: DataFrame
    sellers: DataFrame | None = None
    geolocation: DataFrame | None = None

    def items(self):
        for f in fields(self):
            df = getattr(self, f.name)
            if df is not None:
                yield f.name, df


class MissingInputError(FileNotFoundError):
    """Raw data is absent; nothing is trained."""


def raw_file(name: str, fmt: str = "csv") -> str:
    return RAW_FILES[name] if fmt == "csv" else RAW_FILES[name].replace(".csv", f".{fmt}")


def require_inputs(spark: SparkSession, raw_dir: str, names=REQUIRED, fmt: str = "csv") -> None:
    """S5 guard: asks the folder's own file system (local, HDFS, object store)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(raw_dir)
    fs = folder.getFileSystem(conf)
    missing = [raw_file(n, fmt) for n in names
               if not fs.exists(jvm.org.apache.hadoop.fs.Path(folder, raw_file(n, fmt)))]
    if missing:
        raise MissingInputError(f"raw input missing in {raw_dir}: {', '.join(missing)}")


def null_tokens_to_null(df: DataFrame) -> DataFrame:
    """String columns: pandas' default missing-value tokens become null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(NA_TOKENS), F.lit(None).cast(S)).otherwise(c).alias(f.name)
        out.append(c)
    return df.select(*out)


def parse_timestamps(df: DataFrame, columns, fmt: str = TIMESTAMP_FORMAT) -> DataFrame:
    """String -> timestamp with an explicit format. Under ANSI mode a malformed
    value raises, as the reference's parser does."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.to_timestamp(F.col(c), fmt).cast(T.TimestampNTZType())
                           for c in present})


MULTILINE_TABLES = ("reviews",)   # the only table with free text, so the only one not split


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType,
                   multiline: bool = True) -> DataFrame:
    """Quoted free text may hold newlines and doubled quotes: multiLine + escape '"'. A
    multiLine file is read by one task, so it is asked for where newlines can occur."""
    return (spark.read.schema(schema)
            .option("header", "true").option("multiLine", str(multiline).lower())
            .option("escape", '"').option("quote", '"').option("mode", "FAILFAST")
            .csv(path))


def load_raw(spark: SparkSession, raw_dir: str, with_aux: bool = False,
             fmt: str = "csv") -> RawTables:
    """S1 (and S2 with ``with_aux``): the seven tables, typed, timestamps parsed."""
    names = list(REQUIRED) + (["sellers", "geolocation"] if with_aux else [])
    require_inputs(spark, raw_dir, names, fmt)
    out = {}
    for name in names:
        if fmt == "csv":
            path = f"{raw_dir.rstrip('/')}/{raw_file(name)}"
            df = null_tokens_to_null(read_csv_table(spark, path, SCHEMAS[name],
                                                    name in MULTILINE_TABLES))
        else:
            df = spark.read.parquet(f"{raw_dir.rstrip('/')}/{raw_file(name, fmt)}")
        text = [c for c in TIMESTAMP_COLUMNS.get(name, [])
                if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
        out[name] = parse_timestamps(df, text)
    return RawTables(**out)


def to_raw_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in the raw file order; a column the frame lacks is written empty."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if isinstance(f.dataType, T.StringType) and f.name in df.columns and \
                isinstance(df.schema[f.name].dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, TIMESTAMP_FORMAT)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def write_raw_csv(raw: RawTables, out_dir: str, mode: str = "overwrite") -> None:
    """Write the tables in the raw CSV layout (one folder per file name)."""
    for name, df in raw.items():
        (to_raw_schema(df, SCHEMAS[name]).write.mode(mode)
         .option("header", "true").option("escape", '"').option("quote", '"')
         .csv(os.path.join(out_dir, RAW_FILES[name]) if "://" not in out_dir
              else f"{out_dir.rstrip('/')}/{RAW_FILES[name]}"))


def write_raw_parquet(raw: RawTables, out_dir: str, mode: str = "overwrite") -> None:
    """Write the tables in the raw Parquet layout (one folder per file name)."""
    for name, df in raw.items():
        to_raw_schema(df, SCHEMAS[name]).write.mode(mode).parquet(
            f"{out_dir.rstrip('/')}/{raw_file(name, 'parquet')}")
