import pytest

from turnmill.functions.stems import stem, stems

# Published examples of the algorithm.
KNOWN = {
    "training": "train", "trains": "train", "trained": "train", "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "feed": "feed", "plastered": "plaster", "hopping": "hop",
    "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valency": "valenc", "digitizer": "digit",
    "radically": "radic", "differently": "differ", "vilely": "vile", "analogously": "analog", "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "formality": "formal", "sensitivity": "sensit", "triplicate": "triplic", "formative": "format", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "airliner": "airlin",
    "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "communism", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "controlling": "control", "rolling": "roll", "generally": "general", "generate": "generat", "dying": "die", "gently": "gentl", "succeed": "succeed", "by": "by", "say": "say", "cry": "cri", "été": "été", "boy's": "boy",
    "consistency": "consist", "knightly": "knight", "kneeling": "kneel", "consolatory": "consolatori", "consignment": "consign", "gas": "gas", "this": "this", "kiwis": "kiwi", "bleed": "bleed", "luxuriated": "luxuri",
}


@pytest.mark.parametrize("word", KNOWN)
def test_stem(word):
    assert stem(word) == KNOWN[word]


def test_stems(spark):
    df = spark.createDataFrame([(["training", "signed forms", ""],), (None,), ([],)], "w array<string>")
    assert [r["s"] for r in df.select(stems("w").alias("s")).collect()] == [["train", "sign form", ""], None, []]
