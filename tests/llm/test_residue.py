from folioforge.llm import residue as R

RESIDUE = [
    "Please enable JavaScript to view this page.", "Menu Browse About\n<noscript>You need to enable JavaScript to run this app.</noscript>", "Veuillez activer JavaScript pour afficher cette page.",
    "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Su navegador bloquea los scripts.", "HTTP/1.1 503 Service Unavailable", "Oops! The page abcDEFghij is missing or was moved.",
    "Accès refusé.", "AccÃ¨s refusÃ©.", "Die angeforderte Einreichung abc existiert nicht.", '{"error": {"code": 403, "reason": "forbidden"}}', "Traceback (most recent call last):\n  x",
    "A fine abstract about search.\n\nLorem ipsum dolor sit amet consectetur elit sed magna.", "We thank {{ reviewer_name }} for the report.", "Dear [Your Name], thank you.", "The gain is ${result} points.",
    "Results on «DATASET_NAME» are good.", "Each of [insertar num papers] was read.", "Runtime falls to <%= score %> seconds.", "Title: ______\nAbstract: ............", "Strengths: Click or tap to enter text.",
    "Titre: [oui/non]", "Here comes the abstract.", "Texte de démonstration à remplacer.", "TODO: describe how the model is trained.", "Dear undefined, your report has been received.",
]
CLEAN = [
    None, "", "  \n ", "We study prompts of the form \"Translate {{source}} into {{target}}\" and vary the names.", "The annotation interface required JavaScript, so eleven participants could not take part.",
    'A classifier for error pages ("access denied", "page not found") filters the web corpus first.', "Let $\\mathcal{L} = \\sum_{i} x_{i}$ and $\\hat{\\theta}$ its minimiser.",
    "Nous excluons les pages contenant « veuillez activer JavaScript » du corpus.", "Requests that returned 404 Not Found were removed from the crawl before deduplication.",
    "As a control we replace the passage with lorem ipsum of the same length.", "Inputs are wrapped as [CLS] query [SEP] and hidden with [MASK] or <unk>.", "Python users call `\"{0} and {1}\".format(a, b)`.",
    'Generated reviews that still contain "[Your Name]" are flagged.', "Summary\nA short paper.\nStrengths\nClear writing.", "The word \"placeholder\" is used for a learned vector.", "Rating: 5/10",
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def test_residue_and_what_only_speaks_of_it(spark):
    got = {r.doc_id for r in R.residue_documents(docs(spark, RESIDUE + CLEAN)).collect()}
    missed = [t for i, t in enumerate(RESIDUE) if i not in got]
    wrong = [t for i, t in enumerate(CLEAN, len(RESIDUE)) if i in got]
    assert (missed, wrong) == ([], [])


def test_weak_messages_need_to_recur(spark):
    message = "Loading failed for part 7"
    once = docs(spark, [message, "A fine abstract."])
    often = docs(spark, [message.replace("7", str(i)) for i in range(6)] + ["A fine abstract."])
    same_source = spark.createDataFrame([(i, message, "s") for i in range(6)], "doc_id long, text string, source string")
    assert R.residue_documents(once).count() == 0 and R.residue_documents(same_source).count() == 0
    assert {r.doc_id for r in R.residue_documents(often).collect()} == set(range(6))


def test_thin_fields_need_a_second(spark):
    got = {r.doc_id for r in R.residue_documents(docs(spark, ["Title: ______", "Title: ______\nSummary: ......", "Good text\nStrengths: write here\nWeaknesses: ____"])).collect()}
    assert got == {1, 2}


def test_long_text_repeats_nulls_and_columns(spark):
    from pyspark.sql import functions as F

    long = "An ordinary sentence about ranking. " * 20_000 + "Please enable JavaScript to view this page."
    df = docs(spark, [long, "x" * 100_000]).unionAll(docs(spark, [long])).withColumn("kind", F.lit("k")).withColumn("mask", F.lit("m")).withColumn("source", F.lit(None).cast("string"))
    assert [r.doc_id for r in R.residue_documents(df).collect()] == [0]
    assert R.residue_documents(df.where("false")).count() == 0


def test_masking_groups_messages(spark):
    rows = docs(spark, ["Request ID 3fa9b2c1", "Request ID 77aa01ee", "Request id 12345678"])
    assert R.classified(R.candidate_messages(rows)).select("mask", "n_docs", "n_sources").collect() == [("request id 0", 3, 3)]
