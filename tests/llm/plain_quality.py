"""A plain version of the quality score."""

import numpy as np

from nightglass.llm import cnn_quality as C


def brute_score(net, raw):
    codes = list(raw) + [C.PAD] * ((-len(raw)) % C.BLOCK if raw else C.BLOCK)
    n = len(codes) // C.BLOCK
    codes += [C.PAD] * C.WIDTH
    seen = np.array([np.concatenate([net.embed[c] for c in codes[i : i + C.WIDTH]]) @ net.filters for i in range(n * C.BLOCK)])
    blocks = np.maximum(seen.reshape(n, C.BLOCK, -1).max(1) + net.bias, 0)
    chunks = np.array([np.maximum(blocks[k], blocks[k + 1]) for k in range(n - 1)]) if n > 1 else blocks
    return 1 / (1 + np.exp(-(np.hstack((chunks.mean(0), chunks.max(0))) @ net.out + net.out_bias)))
