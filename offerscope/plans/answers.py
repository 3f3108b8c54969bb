"""Query of answer validation: an answer and its evidence for each given order, in which every issue occurs."""

from pyspark.sql import functions as F

from offerscope import adapters as A
from offerscope.operators import claims
from offerscope.registry import query

_ANSWERS = ("Konut vade {m2} ay [S1].", "Konut vade {m} gün [S1].", "Konut vade {m} ay.", "Konut vade {m} ay [S9].", "Konut vade {m} ay [S1][S2].", "Ziraat Katılım konut vade {m} ay [S1].", "Bambaşka bilgiler anlatan cümle buradadır [S1].", "[S1]", "- Konut tutar {t2} TL, oran %{r} [S1].\n- Taşıt vade {m2} ay [S2].")
_FIRST, _SECOND = "Konut finansmanı vade {m} ay, oran %{r} ve tutar {t} TL.", "Taşıt finansmanında vade {m} ay."


def _filled(text, values):
    for name, value in values.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), value.cast("string"))
    return text


@query("l11_answer_issues", """WITH o AS (SELECT o_orderkey AS answer_id, o_orderkey % 9 AS k, o_custkey % 36 + 1 AS m, o_custkey % 36 + 1 + (o_custkey % 3 = 0)::INT AS m2, o_orderkey + (o_custkey % 3 = 0)::INT AS t2, o_custkey % 3 = 0 AS off FROM orders)
SELECT answer_id, 1 AS claim, 'unsupported_numbers' AS issue, m2 || ':month' AS detail FROM o WHERE k = 0 AND off UNION ALL SELECT answer_id, 1, 'unsupported_numbers', m || ':day' FROM o WHERE k = 1
UNION ALL SELECT answer_id, 0, 'missing_citations', '' FROM o WHERE k = 2 UNION ALL SELECT answer_id, 1, 'missing_citation', '' FROM o WHERE k = 2 UNION ALL SELECT answer_id, 0, 'unknown_citations', 'S9' FROM o WHERE k = 3
UNION ALL SELECT answer_id, 1, 'cross_offer_context', '' FROM o WHERE k = 4 UNION ALL SELECT answer_id, 1, 'bank_context_mismatch', '' FROM o WHERE k = 5 UNION ALL SELECT answer_id, 1, 'unsupported_text', '' FROM o WHERE k = 6 UNION ALL SELECT answer_id, 1, 'empty', '' FROM o WHERE k = 7
UNION ALL SELECT answer_id, 1, 'unsupported_numbers', t2 || ':currency' FROM o WHERE k = 8 AND off UNION ALL SELECT answer_id, 2, 'unsupported_numbers', m2 || ':month' FROM o WHERE k = 8 AND off""")
def l11_issues(spark, d):
    o = A.table(spark, d, "orders")
    off = (F.col("o_custkey") % 3 == 0).cast("int")
    m = F.col("o_custkey") % 36 + 1
    values = {"m2": m + off, "m": m, "t2": F.col("o_orderkey") + off, "t": F.col("o_orderkey"), "r": F.col("o_orderkey") % 4 + 1}
    answers = o.select(F.col("o_orderkey").alias("answer_id"), _filled(F.get(F.array(*map(F.lit, _ANSWERS)), (F.col("o_orderkey") % 9).cast("int")), values).alias("text"))
    one = lambda s, offer, bank, text: F.struct(F.lit(s).alias("source_id"), F.lit(offer).alias("offer_id"), F.lit(bank).alias("bank"), _filled(F.lit(text), values).alias("text"))
    evidence = o.select(F.col("o_orderkey").alias("answer_id"), F.inline(F.array(one("S1", "o1", "Vakıf Katılım", _FIRST), one("S2", "o2", "Ziraat Katılım", _SECOND))))
    return claims.validate(answers, evidence)
