"""What Python workers hold from one stage to the next."""

import pytest

from graphloom.llm import pretokens, simhash, toxicity, worker


class Caught:
    """Stands for a frame; returns the function that its tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


@pytest.mark.parametrize("stage", [simhash.fingerprints, simhash.shingle_sets])
def test_a_stage_forgets_what_others_remember(stage):
    pretokens.encoder(pretokens.vocabulary("byte_bpe_50k.json")).encode(["some words"])
    toxicity.bucket("word")
    assert pretokens._encoders and toxicity._buckets
    assert list(stage(Caught())(iter([]))) == []
    assert not pretokens._encoders and not toxicity._buckets


def test_a_stage_keeps_what_it_remembers_itself():
    found = pretokens.encoder(pretokens.vocabulary("byte_bpe_50k.json"))
    worker.begins("tokens")
    assert pretokens.encoder(pretokens.vocabulary("byte_bpe_50k.json")) is found
    toxicity.bucket("word")
    worker.begins("toxicity")
    assert toxicity._buckets and not pretokens._encoders
