"""Column-expression helpers (all JVM-side, whole-stage-codegen friendly)."""

from cvframe.functions.hashing import keyed_md5  # noqa: F401
from cvframe.functions.link import argmax2, logsumexp2, sigmoid, softplus, threshold  # noqa: F401
from cvframe.functions.text import STRIP_PATTERN, TOKEN_PATTERN, strip_text, tokenize  # noqa: F401
