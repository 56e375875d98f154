"""Subject, relation, object and qualifier of a claim by surface rules, and a trained stance baseline."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, SQLTransformer, StringIndexer
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..runtime import computed

_QUOTED = r"(?<![\p{L}\p{N}_])'[^']{2,}'(?![\p{L}\p{N}_])|\"[^\"]{2,}\"|“[^”]{2,}”|‘[^’]{2,}’"
_WORD = r"[\p{L}\p{N}_]+"
_CONTRACTED = r"(?<![\p{L}\p{N}_])(?:" + "|".join(pattern for pattern, _ in V.CONTRACTIONS) + r")(?![\p{L}\p{N}_])"
_FRINGE = r"^[\s,:;-]+|[\s,:;.!?-]+$"


def found_relation(text: Column) -> Column:
    """struct<relation, word>: the relation that a text states and the wording that shows it; null without one.

    Of every hint only the first place in the text counts; a place outside quotations goes before one inside, then the
    earliest wins. Contractions ("isn't", "it's") and "not dead" stand for their verb and are never taken as quoted."""
    low = F.lower(text)
    parts = F.coalesce(F.regexp_extract_all(low, F.lit(f"{_CONTRACTED}|{_QUOTED}|{_WORD}"), F.lit(0)), T.empty())
    place = lambda word, quoted: F.struct(word.alias("word"), quoted.alias("quoted"))
    words = F.flatten(
        F.transform(
            parts,
            lambda p: F.when(p.rlike(f"^(?:{_QUOTED})$"), F.transform(F.regexp_extract_all(p, F.lit(_WORD), F.lit(0)), lambda w: place(w, F.lit(True)))).otherwise(F.array(place(p, F.lit(False)))),
        )
    )
    hints = F.filter(words, lambda w: w["word"].isin(*V.RELATION_HINTS) | w["word"].rlike(f"^(?:{_CONTRACTED})$"))
    once = F.transform(F.array_distinct(F.transform(hints, lambda w: w["word"])), lambda w: F.filter(hints, lambda x: x["word"] == w)[0])
    chosen = F.coalesce(F.try_element_at(F.filter(once, lambda w: ~w["quoted"]), F.lit(1)), F.try_element_at(once, F.lit(1)))["word"]
    verb = chosen
    for pattern, name in V.CONTRACTIONS:
        verb = F.when(chosen.rlike(f"^{pattern}$"), name).otherwise(verb)
    return F.when(chosen.isNotNull(), F.struct(verb.alias("relation"), chosen.alias("word")))


def structured_slots(claims: DataFrame, text: str = "text") -> DataFrame:
    """Adds subject, relation, object, qualifier (each null where the rule finds none) and ``full`` (all three slots).

    The relation is found_relation's. The subject is the last run of capitalised words before it, else up to five words
    before it. The object is what follows, up to a clause that says how or when ("not dead" is an object itself). The
    qualifier is what stands before a colon, or up to six words before the first comma. Native, one row in, one row out;
    null and empty texts have null slots."""
    t = F.regexp_replace(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+", " ")
    base = computed(claims, _t=t)
    named = computed(base, _found=found_relation(F.col("_t")))
    at = F.regexp_instr(F.lower("_t"), F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), F.col("_found.word"), F.lit(r"(?![\p{L}\p{N}_])")))
    placed = computed(named, _at=F.coalesce(at, F.lit(0)))
    whole = F.col("_found.word") == "not dead"
    parts = computed(
        placed,
        _before=F.substring("_t", F.lit(1), F.col("_at") - 1), _relation=F.col("_found.relation"),
        _after=F.substring(F.col("_t"), F.col("_at") + F.when(whole, 0).otherwise(F.length("_found.word")), F.length("_t")),
    )
    lead = F.regexp_replace(F.when(F.col("_relation").isNull(), F.col("_t")).otherwise(F.regexp_replace("_before", _QUOTED, " ")), r"^[^:]*:", "")
    runs = F.regexp_extract_all(lead, F.lit(r"\p{Lu}[\p{L}'’-]*(?: \p{Lu}[\p{L}'’.-]*)*"), F.lit(0))
    words = F.filter(F.split(F.regexp_replace(lead, _FRINGE, ""), " "), lambda w: (w != "") & ~F.lower(w).isin("the", "a", "an", "that", "this", "in", "on", "at", "by", "of", "to", "for"))
    named = F.filter(runs, lambda r: ~r.isin("The", "A", "An", "In", "On", "At", "It", "That", "This"))
    subject = F.coalesce(F.try_element_at(named, F.lit(-1)), F.array_join(F.slice(words, 1, 5), " "))
    rest = F.regexp_replace(F.regexp_replace("_after", r"(?i)\s+(?:as|claiming|while|because|after|before|when|during|since|in \d{4}|on [A-Z][a-z]+ \d{1,2})\b.*$", ""), _FRINGE, "")
    head = F.regexp_extract("_t", r"^([^:,]+)([:,])", 1)
    by_colon = F.regexp_extract("_t", "^([^:]+):", 1)
    qualifier = F.when(by_colon != "", F.trim(by_colon)).when((head != "") & (F.size(F.split(F.trim(head), " ")) <= 6), F.trim(head))
    out = parts.withColumns({"subject": F.nullif(F.regexp_replace(subject, _FRINGE, ""), F.lit("")), "relation": F.col("_relation"), "object": F.when(F.col("_relation").isNotNull(), F.nullif(rest, F.lit(""))), "qualifier": qualifier})
    return out.withColumn("full", F.col("subject").isNotNull() & F.col("relation").isNotNull() & F.col("object").isNotNull()).drop("_t", "_found", "_at", "_before", "_relation", "_after")


def _dampened(counts: SparseVector) -> SparseVector:
    return Vectors.sparse(counts.size, counts.indices, 1 + np.log(counts.values))


class SublinearCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """1 + ln(count) of the counts of a sparse vector; absent terms stay absent."""

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(inputCol="counts", outputCol="dampened")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), F.udf(_dampened, VectorUDT())(self.getInputCol()))


def stance_pipeline(features: int = 1 << 16, regularisation: float = 0.01) -> Pipeline:
    """TF-IDF of words and word pairs with sublinear counts, and balanced logistic regression.

    Input columns: tokens (array), label_text, weight. Prediction column: predicted (index by frequency of the label)."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol="label_text", outputCol="label_index", handleInvalid="skip", stringOrderType="frequencyDesc"),
            NGram(n=2, inputCol="tokens", outputCol="pairs"),
            SQLTransformer(statement="SELECT *, concat(tokens, pairs) AS terms FROM __THIS__"),
            HashingTF(inputCol="terms", outputCol="counts", numFeatures=features),
            SublinearCounts(),
            IDF(inputCol="dampened", outputCol="features", minDocFreq=2),
            LogisticRegression(featuresCol="features", labelCol="label_index", weightCol="weight", regParam=regularisation, maxIter=20, predictionCol="predicted"),
        ]
    )


def stance_rows(records: DataFrame, text: str, label: str) -> DataFrame:
    """Rows for the pipeline: tokens, label and a weight that balances the labels."""
    rows = records.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("labels"))
    weights = counts.join(F.broadcast(total)).select(label, (F.col("total") / (F.col("labels") * F.col("n"))).alias("weight"))
    return rows.join(weights, label).withColumn("tokens", T.token_list(F.col(text))).withColumn("label_text", F.col(label))
