"""Codes of the n-gram trie where contexts are counted so often that 8 bits end."""

import numpy as np

from spectrafold.llm import ngram_trie


def test_codes_of_common_contexts(tmp_path):
    words = 1000
    word, n = np.array([1, 5, 7, 900], np.uint64), np.array([1, 30, 10**6, 998_999_969])
    level = -np.log10(n / (10**9 + ngram_trie.MU))
    build, path = ngram_trie.EliasFano.build, str(tmp_path / "pairs")
    one = [*build(np.array([3], np.uint64), words + 1).arrays(), *build(np.array([0, 4], np.uint64), 5).arrays(), *build(word, words).arrays()]
    ngram_trie.save(path, [*one, ngram_trie.coded(level)])
    found = ngram_trie.Pairs([path]).find(np.full(5, 3), np.append(word.astype(np.int64), 6), words)
    assert (np.abs(found[:4] + level) <= ngram_trie.STEP / 2 + 1e-9).all() and found[4] == -np.inf
    assert ngram_trie.coded(level[1:]).dtype == np.uint8
    assert (np.abs(ngram_trie.coded(np.array([19.3])) * ngram_trie.STEP - 19.3) <= ngram_trie.STEP / 2).all()
