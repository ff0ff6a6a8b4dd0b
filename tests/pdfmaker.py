from lectern.sources.pdf.maker import *  # noqa: F403
