"""The key of pseudonyms on a cluster that has none of its own."""

from types import SimpleNamespace

from corridor.llm import queries


def _session(application, master="spark://host:7077"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master=master, applicationId=application))


def test_a_cluster_draws_a_key_for_each_application():
    first, again, other = (queries.pseudonym_key(_session(a)) for a in ("app-1", "app-1", "app-2"))
    assert first == again and len(first) == 32
    assert other != first and queries.PSEUDONYM_KEY not in (first, other)
    assert queries.pseudonym_key(_session("app-3", "local-cluster[3,2,3000]")) == queries.PSEUDONYM_KEY
