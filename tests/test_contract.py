import __spark_entry__ as E


def test_driver_contract_shape():
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)
    assert len(qs) >= 40
    own = {n for n in qs if n != "pipeline" and not (n.startswith("op") and n[2:3].isdigit())}
    assert own - set(ors) == {"tagger_fit_tag", "tagger_prf", "governance_run"}   # iterative fits: rows only
