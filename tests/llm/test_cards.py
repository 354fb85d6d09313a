"""Payment cards beside other digits."""

from tessella.llm import pii


def test_cards_beside_other_numbers(spark):
    card, dashed = "4111 1111 1111 1111", "4111-1111-1111-1111"
    texts = [f"pay {card} 12/27 now", "4111111111111111 123", f"7 {dashed}", "4111 1111 1111 1112 12/27"]
    rows = pii.report(spark.createDataFrame(list(enumerate([*texts, card])), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    new = rows[4].text
    assert new != card and [r.n_card for r in rows] == [1, 1, 1, 0, 1]
    assert [r.text for r in rows[:4]] == [f"pay {new} 12/27 now", f"{new.replace(' ', '')} 123", f"7 {new.replace(' ', '-')}", texts[3]]
