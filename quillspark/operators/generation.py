"""Generated texts against reference texts: ROUGE-1, -2 and -L, and BLEU-4."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Longest n-grams that are counted.
LONGEST = 4


def tokens(text: Column) -> Column:
    """Words, and every other sign that is no white space; Chinese characters stand alone."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+|[^\s\p{L}\p{N}]"), F.lit(0))


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of a longest common subsequence.  A bit for each place of a says that the table grows there; a token of b moves all of a row by one addition."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for x in b:
        met = row & at.get(x, 0)
        row = (row + met | row - met) & whole
    return len(a) - row.bit_count()


def shared_ngrams(a: list[int], b: list[int], n: int) -> int:
    """How many n-grams both have, each as often as the one that has it less often."""
    return (Counter(zip(*(a[i:] for i in range(n)), strict=False)) & Counter(zip(*(b[i:] for i in range(n)), strict=False))).total()


@F.pandas_udf(StructType([StructField("lcs", IntegerType()), StructField("shared", ArrayType(IntegerType()))]))  # type objects: a text would need a session at import
def _overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    pairs = [(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame({"lcs": [lcs_length(x, y) for x, y in pairs], "shared": [[shared_ngrams(x, y, n) for n in range(1, LONGEST + 1)] for x, y in pairs]})


def _bleu(shared: Column, said: Column, wanted: Column) -> Column:
    """BLEU of up to four words with the brevity penalty; the k-th n-gram order without a match counts as 1 / 2**k of one."""
    total, missed = F.lit(0.0), F.lit(0)
    for n in range(1, LONGEST + 1):
        has = F.get(shared, F.lit(n - 1))
        missed = missed + F.when(has == 0, 1).otherwise(0)
        total = total + F.log(F.when(has > 0, has.cast("double")).otherwise(F.pow(F.lit(0.5), missed)) / F.greatest(said - (n - 1), F.lit(1))) / LONGEST
    brevity = F.when(said > wanted, 1.0).otherwise(F.exp(1 - wanted / said))
    return F.when(F.get(shared, F.lit(0)) == 0, 0.0).otherwise(brevity * F.exp(total))


def text_scores(rows: DataFrame, prediction: str, reference: str) -> DataFrame:
    """Rows with rouge_1, rouge_2, rouge_l (F measures) and bleu_4; null where a side has no tokens.

    Tokens go to Python as hashes, in Arrow batches; all that is not counting stays in columns.
    """
    hashed = lambda c: F.transform(tokens(F.col(c)), lambda t: F.xxhash64(t))
    both = rows.withColumns({"_said": hashed(prediction), "_wanted": hashed(reference)})
    live = (F.size("_said") > 0) & (F.size("_wanted") > 0)
    out = both.withColumn("_o", _overlap("_said", "_wanted"))
    said, wanted, shared = F.size("_said"), F.size("_wanted"), F.col("_o.shared")
    f1 = lambda hit, n: F.coalesce(F.try_divide(2.0 * hit, F.greatest(said - n, F.lit(0)) + F.greatest(wanted - n, F.lit(0))), F.lit(0.0))
    scores = {"rouge_1": f1(F.get(shared, F.lit(0)), 0), "rouge_2": f1(F.get(shared, F.lit(1)), 1), "rouge_l": f1(F.col("_o.lcs"), 0), "bleu_4": _bleu(shared, said, wanted)}
    return out.withColumns({k: F.when(live, v) for k, v in scores.items()}).drop("_said", "_wanted", "_o")


def mean_text_scores(rows: DataFrame, prediction: str, reference: str, *by: str) -> DataFrame:
    """Means of text_scores() times 100, to six digits, over the pairs with tokens on both sides, and how many there are."""
    scored = text_scores(rows, prediction, reference).where("rouge_1 is not null")
    return scored.groupBy(*by).agg(*(F.bround(100 * F.avg(c), 6).alias(c) for c in ("rouge_1", "rouge_2", "rouge_l", "bleu_4")), F.count("*").alias("pairs"))
