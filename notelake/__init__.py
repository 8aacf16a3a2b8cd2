"""Analytics over notes, documents, chat logs and facts, as DataFrame-in, DataFrame-out functions."""
