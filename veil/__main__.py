from veil.cli import main

raise SystemExit(main())
