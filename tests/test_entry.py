import __spark_entry__ as contract


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert "channel_event_mean" in contract.queries()
