from sketchframe.functions.hashing import (  # noqa: F401
    below,
    hash64,
    normal,
    sign,
    stream_key,
    uniform,
)
from sketchframe.functions.numeric import (  # noqa: F401
    approx_sigmoid,
    logistic,
    taylor_term,
    threshold,
)
