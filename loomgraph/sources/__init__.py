"""Where inputs come from: configuration, source trees, history, ledgers."""
