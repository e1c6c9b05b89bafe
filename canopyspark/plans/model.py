"""The learned detector: features, variants under a spatial hold-out, the chosen one's map, and what it adds to the rule."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.config import CONFIG
from canopyspark.operators import forest, rules
from canopyspark.operators.scratch import written
from canopyspark.plans.layers import classes, texture_by_row
from canopyspark.sources.synthetic import height

SIDE, TILE, COMPONENTS = CONFIG.side, 64, 4
RADAR = ["first", "last", "diff", "min_later", "texture", "slope", "worldcover"]
SINGLE = ["last", "texture"]
EMBEDDED = [f"emb{k + 1}" for k in range(COMPONENTS)]


def embedding_components(spark, d, k: int = COMPONENTS) -> DataFrame:
    """vec_id and the first k principal components of every usable embedding."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x))")
    e = e.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    found = PCA(k=k, inputCol="v", outputCol="p").fit(e).transform(e).select("vec_id", vector_to_array("p").alias("p"))
    return found.select("vec_id", *[F.col("p")[i].alias(f"emb{i + 1}") for i in range(k)])


def features(spark, d, block: int = forest.BLOCK) -> DataFrame:
    """The pixel table with its classes, blocks, and all features; a tile of TILE x TILE pixels takes the components of its own embedding."""
    px = classes(spark, d, texture_by_row(spark, d)).drop("conf")
    tiles = -(-height(spark, d) // TILE) * (SIDE // TILE)
    tile = F.floor(F.col("r") / TILE) * (SIDE // TILE) + F.floor(F.col("c") / TILE)
    px = px.withColumn("vec_id", tile)
    components = written(embedding_components(spark, d).where(F.col("vec_id").between(0, tiles - 1)), "components")
    px = written(px.join(components, "vec_id", "left").fillna(0.0, EMBEDDED).drop("vec_id"), "features")
    derived = {
        "texture": F.col("texture") / 100,
        "diff": F.col("first") - F.col("last"),
        "slope": (F.col("r") * 7 + F.col("c") * 13) % 30,  # layers that no label depends on
        "worldcover": F.when((F.col("r") + F.col("c")) % 11 == 0, 80).otherwise(10),
    }
    return forest.with_block(px.withColumns(derived), SIDE, block)


VARIANTS = {"radar features": RADAR, "radar + embeddings": RADAR + EMBEDDED}
SINGLE_VARIANTS = {"radar features": SINGLE, "radar + embeddings": SINGLE + EMBEDDED}


def model_selection(spark, d, block=forest.BLOCK):
    """Two variants of features on held-out blocks, and which of them is used."""
    return forest.selected(features(spark, d, block), VARIANTS)[2]


def single_date_selection(spark, d, block=forest.BLOCK):
    """The same from one scene alone; negatives are all pixels without a label that are far enough from one."""
    px = features(spark, d, block)
    mining = F.when(F.col("year").isNotNull(), 1).when(F.col("d2") > 25, 0)
    return forest.selected(px.withColumn("mining", mining), SINGLE_VARIANTS)[2]


def rf_predict(spark, d, block=forest.BLOCK):
    """Probability of mining of every pixel by the chosen variant, trained outside the blocks held out."""
    px = features(spark, d, block)
    best, forests, _, held = forest.selected(px, VARIANTS)
    found = forests[best].probability(px).join(F.broadcast(held.withColumn("held_out", F.lit(True))), "block", "left")
    return found.select("r", "c", "p", F.coalesce("held_out", F.lit(False)).alias("held_out"))


def confidence_model(spark, d, block=forest.BLOCK):
    """Rule and model together, where either fired: the model counts where the radar changed a little or sees water now."""
    px = features(spark, d, block)
    best, forests, _, _ = forest.selected(px, VARIANTS)
    open_gate = rules.model_gate(F.lit(True), F.col("first"), F.col("last"))
    found = forests[best].probability(px.where(F.col("change_idx").isNotNull() | open_gate))  # elsewhere neither can fire
    fired = F.coalesce(F.col("p") >= forest.FIRES, F.lit(False))
    gated = rules.model_gate(fired, F.col("first"), F.col("last"))
    conf = F.col("change_idx").isNotNull().cast("int") + gated.cast("int")
    return found.select("r", "c", conf.alias("conf"), F.round("p", 6).alias("p")).where("conf > 0")


QUERIES = {f.__name__: f for f in (model_selection, single_date_selection, rf_predict, confidence_model)}
