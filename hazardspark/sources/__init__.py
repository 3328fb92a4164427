"""Where rows come from: station tables, triples, ontologies."""
