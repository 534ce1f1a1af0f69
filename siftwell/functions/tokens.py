"""Counters of a text's tokens, brought to operators as parameters: small objects that travel to tasks and load there."""

from __future__ import annotations

import os

_loaded: dict[str, object] = {}


class TokenCounter:
    """Tokens of a text by a vocabulary file: .json (tokenizers) or .model (sentencepiece), without special tokens around it."""

    def __init__(self, path: str):
        self.path = path

    def _model(self):
        if self.path not in _loaded:
            if self.path.endswith(".model"):
                import sentencepiece

                _loaded[self.path] = sentencepiece.SentencePieceProcessor(model_file=self.path)
            else:
                # A task has one core: threads of the library's own would only take memory, each an arena.
                os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
                from tokenizers import Tokenizer

                made = Tokenizer.from_file(self.path)
                made.no_truncation()
                made.no_padding()
                _loaded[self.path] = made
        return _loaded[self.path]

    def __call__(self, text: str) -> int:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[int]:
        model = self._model()
        if self.path.endswith(".model"):
            return [len(ids) for ids in model.encode(texts)]
        return [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
