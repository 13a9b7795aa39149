from scanfold.llm import license_scan as L

MIT = L.TEMPLATES["MIT text"]
PARTS = [MIT[:MIT.index("The above")], MIT[MIT.index("The above"):MIT.index("THE\n")], MIT[MIT.index("THE\n"):]]
SPLIT = "\n\n".join(PARTS)
PROSE = " ".join(f"plain{i} word{i}" for i in range(700))
TEXTS = {
    "head": (SPLIT + "\n\n" + PROSE, ["MIT text"]),
    "end": (PROSE + "\n\n" + SPLIT, ["MIT text"]),
    "twice": ("\n\n".join([SPLIT, PROSE, SPLIT]), ["MIT text"] * 2),
    "sentence": ("This dataset is released under the MIT License.", ["MIT notice"]),
    "rights": ("Copyright 2021 Acme Corp. All rights reserved.", ["All rights reserved notice"]),
    "line and sentence": ("Released under the MIT License.\n" + PROSE + " it is released under the MIT License and free " + PROSE,
                          ["MIT notice"] * 2),
    "many": ("so released under the MIT License it is " * 300, ["MIT notice"] * 300),
    "far": ("released under plain words of the MIT that are no License at all", []),
    "prose": (PROSE, []), "empty": ("", []),
}


def test_licences_inside_other_text(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in TEXTS.items()], "doc_id string, text string")
    found = {r.doc_id: [h.license for h in r.license_hits] for r in L.scan_licenses(df).collect()}
    assert found == {k: want for k, (_, want) in TEXTS.items()}
