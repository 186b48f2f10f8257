"""Part of weftline; see the README for what lives where."""
