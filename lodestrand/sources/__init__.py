"""Where rows come from and go to: file trees, workspaces, embedders."""
