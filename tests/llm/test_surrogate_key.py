"""The key of a session: its setting, a known one for local sessions alone, a secret of the application for all others."""

from types import SimpleNamespace

import pytest

from stemtally.llm import surrogates


def session(master, application, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default: conf.get(k.rpartition(".")[2], default)), sparkContext=SimpleNamespace(master=master, applicationId=application))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host"])
def test_a_cluster_without_the_setting_draws_a_secret(master):
    one, other = (surrogates.session_key(session(master, x)) for x in ("app-1", "app-2"))
    assert one == surrogates.session_key(session(master, "app-1")) and len(one) == 32
    assert len({one, other, surrogates.session_key(session("local[2]", "app-3"))}) == 3


def test_the_setting_holds_everywhere():
    assert {surrogates.session_key(session(m, "app-4", key="mine")) for m in ("yarn", "local[2]")} == {b"mine"}
    assert surrogates.session_key(session("local-cluster[3,4,1000]", "app-5")) == surrogates.session_key(session("local[2]", "app-6"))
