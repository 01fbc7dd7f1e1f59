"""Words of letters skip the tokenizer's first steps only where these change nothing."""

import json

import pytest

from heritree.llm import token_files as tf

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Plain words, and onntshansh ofthbleingin; don't we'll", "s t re ve m ll d", "Zoë naïve 12ab ab12 x", None, "", "a" * 300, "end. END! (End) <|endoftext|> it's"]


def test_letters_go_without_normalizer_and_pattern_and_give_the_library_s_ids():
    coder = tf.Encoder(PATH)
    assert type(coder.letters.pre_tokenizer).__name__ == "WhitespaceSplit"
    end = coder.end
    assert coder.encode(TEXTS) == [coder._plain(t or "") + end for t in TEXTS]


@pytest.mark.parametrize("change", ["normalizer", "pre_tokenizer"])
def test_other_steps_are_kept(tmp_path, change):
    spec = json.load(open(PATH))
    if change == "normalizer":
        spec["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "a"}, "content": "o"})
    else:
        spec["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    path = tmp_path / "changed.json"
    path.write_text(json.dumps(spec))
    assert type(tf.Encoder(str(path)).letters.pre_tokenizer).__name__ == "Sequence"
