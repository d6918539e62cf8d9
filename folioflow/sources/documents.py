"""Reading and writing document collections, and a generator of synthetic ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: All fields by which collections have grown; any may be missing.
SCHEMA_DDL = """
_id string, title string, content string, tags array<string>, lastAccessed string,
documentType string, searchFrequency int, documentState string, previousDocumentState string, stateTransitionProb double,
timeInCurrentState int, expectedProcessingTime int,
processingWorkflow struct<workflowStage: int, priority: string, complexityScore: double, processingLoad: double, bottleneckRisk: double>,
classificationAnalysis struct<documentCategory: string, classificationConfidence: double, reclassificationProb: double, categoryTransitionMatrix: array<double>, processingTime: double>,
retrievalOptimization struct<accessFrequency: int, searchPath: array<struct<nodeId: string, transitionProbability: double, pathWeight: double>>, retrievalEfficiency: double, cacheHitProbability: double>,
lifecycleAnalysis struct<documentAge: int, expectedLifetime: int, retentionProbability: double, archivalTransitionProb: double, obsolescenceRisk: double>,
systemEfficiency struct<throughputRate: double, queueLength: int, processingBottleneck: boolean, loadBalancingScore: double, systemUtilization: double>,
networkProperties struct<documentNetwork: struct<nodeId: string, networkDegree: int, clusteringCoefficient: double, centralityScore: double>, randomWalkProperties: struct<coverTime: double, mixingTime: double, hittingTime: double>>,
stationaryProbability double, workflowOptimization double, mapReducePartition int, processingNode string, batchId string, aggregationKey string,
documentSimilarity struct<accessMetrics: array<int>, documentType: string, department: string, documentSize: int, relevanceScore: double, userAccessPattern: double>
"""

STATES = ("received", "classified", "processed", "archived", "retrieved")
TYPES = ("report", "memo", "presentation", "email")


def read_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Documents of JSON files: one array a file (multiline), or one document a line, which Spark can split."""
    return spark.read.schema(SCHEMA_DDL).option("multiLine", multiline).json(path)


def read_json_stream(spark: SparkSession, path: str) -> DataFrame:
    """Documents that arrive as files of JSON lines."""
    return spark.readStream.schema(SCHEMA_DDL).json(path)


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Documents held in memory; missing keys are null."""
    return spark.createDataFrame(rows, SCHEMA_DDL)


def write_json(docs: DataFrame, path: str) -> None:
    """One document a line."""
    docs.write.mode("overwrite").json(path)


CATEGORIES = ("report", "contract", "invoice", "memo", "letter", "manual")
DEPARTMENTS = ("finance", "legal", "sales", "research")


def generate(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n synthetic documents with every field of the schema that collections fill.

    Fields follow from seed and number alone, so they are alike on every run and partitioning.
    """
    number = lambda name, k: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(k)).cast("int")
    one_of = lambda name, values: F.element_at(F.array(*map(F.lit, values)), number(name, len(values)) + 1)
    unit = lambda name: number(name, 10_000) / F.lit(10_000.0)
    word = lambda name: F.concat(F.lit("w"), number(name, 900).cast("string"))
    key = lambda name: F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), F.col("id").cast("string"))), 1, 24)
    struct = lambda **fields: F.struct(*[c.alias(k) for k, c in fields.items()])
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(900)).cast("string"))), " ")
    day = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) - number("accessed", 31_536_000)), "yyyy-MM-dd'T'HH:mm:ss")
    step = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit("path"), F.col("id"), i), F.lit(1000))
    path = F.transform(F.sequence(F.lit(1), number("steps", 5) + 3), lambda i: struct(nodeId=F.concat(F.lit("node_"), step(i).cast("string")), transitionProbability=step(i + 100) / 1000.0, pathWeight=step(i + 200) / 1000.0))
    kind, department = one_of("type", TYPES), one_of("department", DEPARTMENTS)
    fields = {
        "_id": key("id"), "title": F.concat_ws(" ", *[word(f"title{i}") for i in range(5)]), "content": content, "tags": F.array(*[word(f"tag{i}") for i in range(3)]), "lastAccessed": F.concat(day, F.lit(" Z")),
        "documentType": kind, "searchFrequency": number("frequency", 100) + 1, "documentState": one_of("state", STATES), "previousDocumentState": one_of("previous", STATES[:4]), "stateTransitionProb": unit("transition"),
        "timeInCurrentState": number("time", 1440) + 1, "expectedProcessingTime": number("expected", 480) + 1,
        "processingWorkflow": struct(workflowStage=number("stage", 5) + 1, priority=one_of("priority", ("low", "medium", "high")), complexityScore=unit("complexity"), processingLoad=unit("load"), bottleneckRisk=unit("risk")),
        "classificationAnalysis": struct(documentCategory=one_of("category", CATEGORIES), classificationConfidence=unit("confidence"), reclassificationProb=unit("again"), categoryTransitionMatrix=F.array(*[unit(f"matrix{i}") for i in range(6)])),
        "retrievalOptimization": struct(accessFrequency=number("accesses", 200), searchPath=path, retrievalEfficiency=unit("retrieval"), cacheHitProbability=unit("cache")),
        "lifecycleAnalysis": struct(documentAge=number("age", 2000), expectedLifetime=number("lifetime", 4000) + 1, retentionProbability=unit("retention"), archivalTransitionProb=unit("archival"), obsolescenceRisk=unit("obsolescence")),
        "systemEfficiency": struct(throughputRate=unit("rate") * 100, queueLength=number("queue", 50), processingBottleneck=number("neck", 2) == 1, loadBalancingScore=unit("balance"), systemUtilization=unit("utilization")),
        "networkProperties": struct(documentNetwork=struct(nodeId=key("node"), networkDegree=number("degree", 50), clusteringCoefficient=unit("clustering"), centralityScore=unit("centrality")), randomWalkProperties=struct(coverTime=unit("cover") * 500, mixingTime=unit("mixing") * 100, hittingTime=unit("hitting") * 100)),
        "stationaryProbability": unit("stationary"), "workflowOptimization": unit("optimization"), "mapReducePartition": number("partition", 25) + 1, "processingNode": F.concat(F.lit("node_"), number("processor", 10).cast("string")),
        "batchId": F.concat(F.lit("batch_"), number("batch", 100).cast("string")), "aggregationKey": F.concat(kind, F.lit("_"), department),
        "documentSimilarity": struct(accessMetrics=F.array(*[number(f"metric{i}", 100) for i in range(4)]), documentType=kind, department=department, documentSize=number("size", 10_000) + 1, relevanceScore=unit("relevance"), userAccessPattern=unit("pattern")),
    }
    return spark.range(n).select(*[c.alias(k) for k, c in fields.items()])
