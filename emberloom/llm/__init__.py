"""Training-data operators: quality, URL lists, media, language model scores, decontamination, archives,
line and near-duplicate removal, token files and byte-level BPE."""
