"""Places of vocabulary files; the operators take them as parameters."""

from __future__ import annotations

import public_tokenizers

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
