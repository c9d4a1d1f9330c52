"""Templates of plans: faults, warnings, and saving."""

from talus.plans import library

SCHEMA = f"id int, description string, dimensions map<string,string>, steps {library.STEP}"
GOOD = [("search", {"q": "x"})]


def test_templates_are_judged_and_saved(spark):
    rows = [
        (1, "d", {"Verb": "Research", "scope": "a"}, GOOD), (2, "d", {"verb": "research", "SCOPE": "A"}, GOOD), (3, " ", {"verb": "x"}, []), (4, None, None, None),
        (5, "d", {"verb": "v", "scope": "s", "mood": "calm"}, [("traverse", {"purpose": "p"})]), (6, "d", {"verb": "w", "scope": "s"}, [("traverse", {"purpose": "p", "link_types": "l"}), (None, None)]), (7, "d", {"verb": "taken", "scope": "s"}, GOOD),
    ]
    templates = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: (r.faults, r.warnings) for r in library.template_faults(templates).collect()}
    assert got[1] == ([], []) and got[2] == (["duplicate"], []) and got[5] == ([], ["unknown dimension mood"]) and got[7] == ([], [])
    assert got[3][0] == ["no description", "no scope", "no steps"] and got[4][0] == ["no description", "no scope", "no steps", "no verb"]
    assert got[6][0] == ["step without tool", "traverse takes link_types or purpose"]
    assert {r.id: r.faults for r in library.template_faults(templates, strict=True).collect()}[5] == ["unknown dimension mood"]
    plans = spark.createDataFrame([(90, {"VERB": "Taken", "scope": "s"}, 3)], "id int, dimensions map<string,string>, uses int")
    saved, refused = library.save(plans, templates)
    assert sorted((r.id, r.uses) for r in saved.select("id", "uses").collect()) == [(1, None), (5, None), (90, 3)]
    assert {r.id: r.faults for r in refused.collect()}[7] == ["duplicate"] and refused.count() == 5
    assert library.save(plans, templates.limit(0))[0].count() == 1
    assert library.template_faults(templates).filter("id = 1").select(library.dimension_key(library.F.col("dimensions"))).first()[0] == library.identity({"Verb": "Research", "scope": "a"}).replace(": ", ":").replace(", ", ",")
