"""A DOI or file that several works share."""

from ferrule.llm import history

SCHEMA = "paper_id string, title string, doi string, filename string"
LONG = "Mapping slow anion redox of quenched Na3PS4 after long ageing in dry argon: what pressure does to thin pellets"
# joining two words moves the quarters' borders, and the misspelt last word leaves no two quarters alike
OTHER, JOINED = "Mapping slow void growth in aged cells of Na3PS4 under pressure and heat", "Mapping slow voidgrowth in aged cells of Na3PS4 under pressure and haet"


def test_each_work_of_a_group_has_a_center(spark):
    rows = [("1", LONG, "10.99100/csr.2020.aaaaaa", "x.pdf"), ("2", OTHER, "10.99100/csr.2020.aaaaaa", "y.pdf"), ("3", JOINED, "10.99100/csr.2020.aaaaaa", "z.pdf")]
    assert [(r.paper_id_a, r.paper_id_b) for r in history.repeats(spark.createDataFrame(rows, SCHEMA)).collect()] == [("2", "3")]
