"""Occurrences that decontamination must not miss, each by itself."""

from ablata.llm import decontaminate as d


def caught(spark, docs, items, **how):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, items, **how).collect()}


SEASON = "team Alpha won 3 games and team Beta won 5 games and team Gamma won 7 games and team Delta won 9 games"
QUESTION = "if the farmer sells {} sheep and buys {} goats on the market then how many animals does the farmer own at the end"


def test_item_that_repeats_its_template(spark):
    other = SEASON.replace("Alpha", "Red").replace("Beta", "Blue").replace("Gamma", "Green").replace("Delta", "Black").replace("3", "12").replace("7", "14")
    assert caught(spark, [SEASON, f"once more {other} in that year", "team Red won 3 games"], [SEASON]) == {(0, 0), (1, 0)}


def test_document_with_several_variants(spark):
    bank = [QUESTION.format(3, 8), QUESTION.format(4, 11), QUESTION.format(17, 5)]
    assert caught(spark, [". ".join(bank), ". ".join(bank[1:])], bank[:1]) == {(0, 0), (1, 0)}


def test_slots_that_do_not_go_together(spark):
    item = "pay 3 now and then 3 at noon and then 3 at dusk and then 3 at night"
    assert caught(spark, ["pay 1 now and then 2 at noon and then 4 at dusk and then 5 at night", item], [item]) == {(1, 0)}


def test_names_that_begin_a_sentence(spark):
    item = "Sam has 3 apples. Sam eats 1. How many are left?"
    docs = [item.replace("Sam", "Tim"), f'He asked: "{item.replace("Sam", "Tim")}"', "so here Tim has 9 apples. Tim eats 2. How many are left?", "Tim has 3 pears. Tim sold 1. How come some are left?", item]
    assert caught(spark, docs, [item]) == {(0, 0), (1, 0), (2, 0), (4, 0)}


def test_digits_behind_letters(spark):
    item = "one costs USD40 and x2 of them cost USD15 less at the fair"
    docs = [item.replace("USD40", "USD41").replace("x2", "x5").replace("USD15", "USD16"), item.replace("USD", "EUR ").replace("x2", "all")]
    assert caught(spark, docs, [item]) == {(0, 0)}


def test_equal_first_words_are_no_slots(spark):
    docs, items = spark.createDataFrame([(1, QUESTION.capitalize())], "doc_id long, text string"), spark.createDataFrame([(1, QUESTION.capitalize())], "item_id long, text string")
    row = d.contaminated(docs, items).collect()[0]
    assert row["n_matched"] == row["n_windows"] and row["n_slots"] == 0 and row["same_slots"]


def test_short_items_inside_longer_texts(spark):
    docs = ["today we ask who wrote hamlet in class", "who wrote hamlet", "who wrote it", "She asks. Who wrote 3 plays", "a tiny item"]
    items = ["who wrote hamlet", "tiny item", "who wrote 5 plays"]
    assert caught(spark, docs, items, short_inside=True) == {(0, 0), (1, 0), (3, 2), (4, 1)}


def test_query_and_pipeline_find_short_items(spark, tmp_path):
    import corpus_pipeline
    from ablata.llm.queries import QUERIES

    docs = spark.createDataFrame([(1, "today we ask who wrote hamlet in class"), (2, "nothing of the kind")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "who wrote hamlet")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r["doc_id"], r["item_id"]) for r in QUERIES["op3_decontamination"](spark, str(tmp_path)).collect()] == [(1, 7)]
    assert [r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()] == [2]
